"""Spark-native analytics for player x match data: tables, ranked queries, temporal
features, models, evaluation and streaming feeds."""

import sys

from pyspark import cloudpickle

# the few Python functions that run inside tasks travel with the job, so executors need no copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
