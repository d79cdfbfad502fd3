"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Its task functions travel to executors
by value, so a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
