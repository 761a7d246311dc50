"""blockwise: corpus packing, top-1 routing, next-token evaluation and run
analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns, for the
scalar helpers in :mod:`blockwise.functions`). No function holds a global
session; the session is always derived from the input frame.
"""

__version__ = "0.1.0"

# Python UDF bodies (encoder, scorer, ordered fold, streaming state) are
# shipped by value, so executors need no installed copy of this package.
import sys as _sys

try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
