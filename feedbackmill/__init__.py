"""Review analytics as Spark jobs: ingest, clean, label, aggregate and query customer reviews."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so that executors need only PySpark,
# pandas and NumPy and not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
