"""Robot knowledge graphs and session telemetry as Spark DataFrames.

Functions that run in Python workers travel by value, so executors need
PySpark and the libraries that a function names, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
