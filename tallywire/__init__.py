"""Network-event analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tallywire.archive import Archive

# The few functions that run in Python workers travel with the plan, so that executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Archive"]
