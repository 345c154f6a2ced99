"""corpusloom: bag-of-words analytics, denoising operators and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions with the tasks, wherever the driver found the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
