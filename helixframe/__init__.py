"""Structural-variant and event analytics expressed as Spark DataFrame plans.

Functions that run in Python workers are sent by value, so executors need Spark and the third-party
libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
