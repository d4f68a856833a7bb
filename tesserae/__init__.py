"""Spark-native document deduplication, lineage and requirement analytics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
