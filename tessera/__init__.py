"""Tessera: a PySpark-native engine for entity resolution, document indexes and text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so workers need not find this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
