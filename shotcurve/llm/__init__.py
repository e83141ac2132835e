"""Operators of a training-data pipeline: dedup, filters, fingerprints, archives, mixing, packing."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
