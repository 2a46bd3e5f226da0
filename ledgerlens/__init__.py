"""Spark-native engine for verifying and reviewing structured documents."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# executors need not have this library installed: functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
