"""Tick and bar analytics for index futures and their constituents, on Spark DataFrames.

Functions that run in Python workers are shipped by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
