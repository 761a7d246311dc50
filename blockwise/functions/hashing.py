"""Seeded, partition-independent randomness.

``rand``/``randn`` depend on the partitioning, so a recomputed task or a
repartitioned input would draw different numbers. These helpers derive
every number from an md5 of the row key instead, so the same row always
gets the same value, in Spark and in SQL engines that have ``md5``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _key(*parts) -> Column:
    cols = [F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string") for p in parts]
    return F.concat_ws(":", *cols)


def hash_uniform(*parts, shift: bool = False) -> Column:
    """Uniform in [0, 1): first 32 bits of md5('p1:p2:...') / 2**32.
    With ``shift`` the value is moved half a step off zero, into (0, 1)."""
    h = F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint").cast("double")
    if shift:
        h = h + F.lit(0.5)
    return h / F.lit(4294967296.0)


def gaussian(*parts) -> Column:
    """Standard normal by Box-Muller from two shifted hash uniforms of the
    key with suffixes 'a' and 'b'."""
    u1 = hash_uniform(*parts, "a", shift=True)
    u2 = hash_uniform(*parts, "b", shift=True)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
