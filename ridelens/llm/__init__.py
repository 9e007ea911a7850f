"""Operators of a large-scale training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions by value, so executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
