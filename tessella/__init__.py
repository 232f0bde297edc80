"""Pair evidence, layout and mosaic analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the package's functions travel to the workers by value, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
