"""Dependency-graph analytics on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions shipped to executors are pickled by value, so a cluster needs no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
