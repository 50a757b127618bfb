"""A knowledge-graph and retrieval engine over large document collections, on Spark.

Functions that run in Python workers are shipped by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
