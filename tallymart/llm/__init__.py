"""Operators that prepare text for language-model training."""

import sys

from pyspark import cloudpickle

# Executors then need no copy of this package to run the functions in it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
