"""Registry analytics on PySpark: DataFrame-to-DataFrame operators for registers of organisations and their links."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
