"""Operators for preparing training text: filtering, deduplication, mixing, tokenising, packing and chat formatting.

Nothing else in the library imports this subpackage. Functions that run in tasks travel by value, so executors need
NumPy, Arrow and the tokenizers library, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
