"""needlebed: exact byte-substring search and corpus analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs neither --py-files nor an installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
