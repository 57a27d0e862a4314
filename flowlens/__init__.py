"""Flow-event analytics and distributed model evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions used in tasks are shipped by value: workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
