"""Spark-native analytics for photovoltaic-fleet telemetry."""

import sys

from pyspark import cloudpickle

# functions of this package go to the executors by value: they run where the package itself is not installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
