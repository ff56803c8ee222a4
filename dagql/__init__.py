"""dagql: partitioned-parallel data processing, declared as DAGs, scripts or functions and run by Spark.

Functions of this package travel to Python workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
