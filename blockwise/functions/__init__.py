"""Column-level helpers (no DataFrame in, no DataFrame out).

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage code generation; none is a Python UDF.
"""

from blockwise.functions.numeric import (  # noqa: F401
    INF, NAN, is_finite, not_missing, to_double, perplexity, improvement_pct,
    throughput, bytes_to_mb, nan_max, last_n, every_k,
)
from blockwise.functions.arrays import (  # noqa: F401
    dot, softmax, top1, top1_prob, logsumexp, cross_entropy, temper,
    layer_norm, draw, add_arrays, scale_array, array_sum,
)
from blockwise.functions.hashing import hash_uniform, gaussian  # noqa: F401
from blockwise.functions.names import parse_run_name, RUN_NAME_PATTERN  # noqa: F401
