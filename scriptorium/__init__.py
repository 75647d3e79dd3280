"""Retrieval and document analytics as Spark set operations."""

import sys

from pyspark import cloudpickle

# Task functions travel whole, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
