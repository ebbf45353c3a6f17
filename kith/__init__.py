"""kith: look-alike audience analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

from kith.options import EmbedOptions, KnnOptions

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EmbedOptions", "KnnOptions"]
