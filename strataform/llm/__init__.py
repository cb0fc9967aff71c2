"""Operators for training-data pipelines.

Functions that run inside tasks are pickled by value, so executors need no copy
of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
