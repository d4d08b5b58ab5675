"""Grouped-observation analytics on Spark DataFrames.

Observations are nested (subject -> visit -> point -> scan -> sample). Every
function takes DataFrames and returns DataFrames; Catalyst picks the physical
plan. See README.md for the map from capability to module.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship this package's task functions inside the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
