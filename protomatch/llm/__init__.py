"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get the code of this subpackage with their work, not by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
