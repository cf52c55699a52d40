"""Operators for building training data; nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Workers need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
