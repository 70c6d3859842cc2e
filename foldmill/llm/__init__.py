"""Operators for preparing large text corpora.

Each module holds one operator; ``queries`` registers one query for each.
Functions that run on executors are pickled by value, so that executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
