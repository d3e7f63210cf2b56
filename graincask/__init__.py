"""graincask: a Spark-native data engine for the data side of coding agents."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
