"""Spark-first engine for building, maintaining and searching a text and code index."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
