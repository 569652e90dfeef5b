"""Operators for training-data pipelines. Nothing outside this package imports it.

Their functions travel to the tasks by value, so a cluster needs numpy and pyarrow but no copy of this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
