"""Operators for training-data corpora: scans, de-duplication, filters, packing and sharding of documents."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the tasks, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
