"""Contract-portfolio analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames to a DataFrame.  Reference
times are parameters, never the wall clock, so a rerun gives the same rows.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
