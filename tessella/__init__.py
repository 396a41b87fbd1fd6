"""tessella: data preparation and analysis operators for Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tessella.session import build_session, cut

# functions sent to tasks travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut"]
