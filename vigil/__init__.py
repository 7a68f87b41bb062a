"""vigil: incident analytics over telemetry tables, written as Spark plans.

Every operator takes DataFrames (plus a ``Params``) and returns a lazy
DataFrame. The caller decides when and where results are materialised; the
exceptions, which run jobs of their own and keep what they need in the shared
folder, are vector search (training and the assignment to cells), counts of log
signatures, and evidence and inputs gathered one by one so that a failing
source costs only itself.
"""

import sys

from pyspark import cloudpickle

from vigil.config import Params

__all__ = ["Params"]

# Functions sent to Python workers travel by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
