"""Packet analytics on Spark: capture text and flow records to scores, labels, alerts and reports."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
