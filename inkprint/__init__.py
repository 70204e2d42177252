"""Code-provenance analytics on Spark: snippets in, features, scores and evaluations out."""

import sys

from pyspark import cloudpickle

# Functions reach executors by value: the package need not be installed or shipped there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
