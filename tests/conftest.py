import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runscope.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="runscope-test-ckpt-")
    wh = tempfile.mkdtemp(prefix="runscope-test-wh-")
    s = get_session("local[4]", app="runscope-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": ckpt, "spark.sql.warehouse.dir": wh})
    yield s


@pytest.fixture()
def tmpdir_path(tmp_path):
    return str(tmp_path)
