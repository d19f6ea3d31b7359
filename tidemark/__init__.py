"""Tidemark: time-series benchmarking and feed curation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python kernels travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
