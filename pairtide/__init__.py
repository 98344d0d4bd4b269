"""Rolling pairwise lead-lag analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from pairtide.config import PairSpec, RoleSpec

# Task functions travel by value, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PairSpec", "RoleSpec"]
