"""driftloom: Spark-native analytics for long sensor recordings and the event tables derived from them."""

import sys

from pyspark import cloudpickle

# Workers get this package's functions by value, so executors need only the public libraries.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
