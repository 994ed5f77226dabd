"""Operators for building language-model training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Tasks get the functions themselves, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
