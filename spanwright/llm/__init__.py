"""Operators of a training-data pipeline.  Nothing else in the library imports this.

Functions that run in Python workers are shipped by value, so executors need
no copy of the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
