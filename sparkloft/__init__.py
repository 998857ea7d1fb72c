"""Relational, window, event-time, streaming, array/JSON and UDF operators over Parquet tables, written for Spark.

Functions that run in Spark's Python workers are sent by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
