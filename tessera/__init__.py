"""tessera: DataFrame operators for subjects with mixed-type items and 0/1 labels."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
