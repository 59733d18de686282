"""flowlab: DataFrame operators for auditing, sampling, modelling and evaluating
large, imbalanced, labelled record tables on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions travel by value with their task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
