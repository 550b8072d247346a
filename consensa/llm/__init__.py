"""Training-data operators: quality rules, deduplication, filters, formatting and packing.

Nothing else in the package imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
