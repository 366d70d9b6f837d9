"""Statistics and data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: the few functions that run in
# tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from abacist.plans.session import build_session  # noqa: E402

__all__ = ["build_session"]
