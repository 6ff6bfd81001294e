"""Station series, forecast runs and interpolation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions run by the tasks travel with the job, so the executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
