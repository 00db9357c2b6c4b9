"""Operators for building training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# tasks carry the code they run, so workers need not have the repository on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
