"""Operators for building training corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need Spark, numpy, pyarrow and the named libraries only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
