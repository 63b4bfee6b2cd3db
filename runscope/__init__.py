"""runscope: data-pipeline health on Spark -- layered warehouse, data tests, run-log triage, agent telemetry."""

import sys

# Python functions that run inside tasks (applyInPandas / applyInPandasWithState) are shipped to the
# executors by value, so executors need no installed copy of this package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the API
    pass
