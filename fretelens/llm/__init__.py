"""Operators of a training-data pipeline, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so that executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
