"""Evidence retrieval over dated articles, as Spark plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

#: Functions travel to Python workers by value, so that executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
