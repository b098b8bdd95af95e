"""Operators for preparing training data, each built by one named method.

Nothing else in the library imports this subpackage. Its functions travel to Python workers by value, so
executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
