"""Finding, ranking and packaging the notable moments of recordings, on Spark tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
