"""Curation and evaluation of labelled image datasets as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the helpers of a UDF with the UDF, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
