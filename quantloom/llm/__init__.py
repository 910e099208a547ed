"""Operators of a large-scale training-data pipeline.

Every operator is a function from DataFrames to DataFrames.  The modules are
shipped to Python workers by value, so an executor needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
