"""Moraine: a PySpark-native engine for glacial-lake hazard analytics.

Task closures defined in this package travel by value, so executors need only
the Python packages that Spark itself needs, not an installed copy of Moraine.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
