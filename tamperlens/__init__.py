"""Spark-native forensics for tabular data.

Every operator takes a DataFrame plus column names and returns a DataFrame with
a flat schema.  See the package README for the operator list.
"""

import sys

from pyspark import cloudpickle

# UDF helpers travel inside the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
