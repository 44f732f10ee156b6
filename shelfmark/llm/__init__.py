"""Operators for preparing training data at scale; nothing else in the library imports them.

Task functions of this package travel by value, so that workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
