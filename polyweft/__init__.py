"""polyweft: Spark-native analytics over flat streams of bounded integer words."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that executors run travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
