"""The driver module without the optional part, or without packages that only that part needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(blocked: str) -> subprocess.CompletedProcess:
    code = ("import sys\n"
            "class Block:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            f"        if name == {blocked!r}:\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, Block())\n"
            "import __spark_entry__ as e\n"
            "print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))")
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True,
                          env=os.environ | {"PYTHONPATH": ROOT})


@pytest.mark.parametrize("blocked", ["runscope.llm", "corpus_pipeline", "public_tokenizers"])
def test_entry_without_the_optional_part(blocked):
    out = _names(blocked)
    n, ops, paired = out.stdout.split()
    assert int(n) >= 60 and ops == "0" and paired == "True", out.stderr


def test_entry_reports_faults_of_its_own_modules():
    assert _names("runscope.plans.registry").returncode != 0
