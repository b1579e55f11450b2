"""Millrace: text-data curation for language-model training, as lazy Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the Python workers by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
