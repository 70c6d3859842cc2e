"""foldmill: analytics on mergeable partial aggregates, expressed as Spark DataFrame plans.

Functions that run on executors are pickled by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
