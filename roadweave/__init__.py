"""Road-sensor analytics on Spark: quality checks, features, warehouse, dashboards, streams, models."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
