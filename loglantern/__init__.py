"""Log and incident analytics on Spark DataFrames and Structured Streaming.

``functions``  column expressions (JSON fields, addresses, embeddings, replies)
``operators``  DataFrame -> DataFrame building blocks (windows, joins, rankings)
``plans``      the end-to-end jobs a user calls
``sources``    readers and writers (Kafka, files, the incident table)
``streaming``  Structured Streaming forms of the jobs
``checks``     fixture views, registered queries and their reference SQL
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
