"""Operators for training-data pipelines. Nothing outside this subpackage imports it.

Functions of this package that run on executors travel by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
