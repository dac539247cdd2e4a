"""Approximate short-pattern matching and corpus operations, declared as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, which need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
