"""ctxforge: context analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
