"""Quarrystone: evidence analytics over documents, records and event logs, Spark first."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
