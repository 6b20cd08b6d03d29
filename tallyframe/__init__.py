"""Profiling, cleaning, balancing, modelling and segmentation of large tables on Spark."""

import sys

from pyspark import cloudpickle

# The Arrow UDFs travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
