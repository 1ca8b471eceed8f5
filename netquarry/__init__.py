"""Network-flow analysis on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions of this package travel with the job, so executors need no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
