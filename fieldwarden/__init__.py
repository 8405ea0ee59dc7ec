"""Per-field review analytics on Spark: preparation, metrics, calibration, policies, audits and serving."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so that an executor needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
