"""Spark-native vector geometry columns."""

import sys

from pyspark import cloudpickle

# Functions for executors travel by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
