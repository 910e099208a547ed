"""A PySpark-native analytics engine: daily panels, event text, streams and training corpora.

Functions that tasks run travel by value, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
