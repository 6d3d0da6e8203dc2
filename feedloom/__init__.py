"""feedloom: feed curation operators for Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers receive the package's functions with the plan, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from feedloom.clock import instant  # noqa: E402
from feedloom.session import configure, drop_stages, scratch_folder, stage  # noqa: E402

__all__ = ["configure", "drop_stages", "instant", "scratch_folder", "stage"]
