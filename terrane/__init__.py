"""Regional customer segmentation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from terrane.params import Params

__all__ = ["Params"]

# Functions of this package travel to the Python workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
