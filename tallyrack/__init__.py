"""A PySpark-native engine for shop registers and daily product-shelf snapshots."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value: executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
