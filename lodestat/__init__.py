"""Left-censored measurement analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
