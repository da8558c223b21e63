"""pollspark: poll and compositional time-series analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few vectorised Python functions travel to the executors by value, so that executors need
# no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
