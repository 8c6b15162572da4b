"""Operators for building language-model training data.

Nothing outside this subpackage, the pipeline module and the guarded part of the
entry module imports it; deleting the folder leaves the retrieval engine whole.
"""

from pyspark import cloudpickle as _cloudpickle

import inkstone.llm as _self

#: Functions of this subpackage travel to Python workers by value, so that executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_self)
