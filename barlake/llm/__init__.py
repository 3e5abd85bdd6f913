"""Operators for training-data corpora; nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# tasks receive this folder's functions with the job, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
