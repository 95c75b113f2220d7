"""textloom: a Spark-native engine for building, auditing and scoring labelled text corpora.

The Python functions that run on executors are pickled by value, so a cluster
needs this package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
