"""Catalog data-quality and change-data jobs on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel by value, so Python
# workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
