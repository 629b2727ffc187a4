"""graphloom: property-graph analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
