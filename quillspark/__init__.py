"""quillspark: retrieval, relevance evaluation and corpus work as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions for Arrow batches travel to the executors by value: these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
