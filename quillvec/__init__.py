"""Embedding-corpus preparation and vector-search quality measurement on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions handed to Python workers travel with their code, so executors need
# no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
