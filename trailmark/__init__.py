"""PySpark-native analytics for sensor, trajectory and observation data."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so that a worker
# needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
