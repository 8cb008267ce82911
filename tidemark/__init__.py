"""Complaint-text analytics as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few helpers that run inside tasks travel with the job, so executors need no installation.
register_pickle_by_value(sys.modules[__name__])
