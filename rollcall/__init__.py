"""Fleet-log analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from rollcall.session import build_session

# The few Python functions that run inside tasks travel with the task, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
