"""Spark jobs that turn game reviews and metadata catalogues into recommender training data."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the tasks, so executors
# need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
