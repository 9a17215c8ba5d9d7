"""Text-preparation analytics on PySpark: extraction, normalisation, segmentation, identity and job state."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
