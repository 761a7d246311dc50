"""Run-name parsing for sweep directories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from blockwise.functions.numeric import _c

# Fixed value (must match the sweep report's grammar): an optional 'all_'
# prefix, then moe_e<E>_rj<RJ>_cf<CF>_s<S>, optional trailing slash.
RUN_NAME_PATTERN = r"^(?:all_)?moe_e(\d+)_rj([\d\.]+)_cf([\d\.]+)_s(\d+)/?$"


def parse_run_name(run) -> Column:
    """Struct (matched, experts INT, rj DOUBLE, cf DOUBLE, steps INT) from a
    run base name; non-matching names have matched = false."""
    r = _c(run)
    g = lambda i: F.regexp_extract(r, RUN_NAME_PATTERN, i)
    return F.struct(
        r.rlike(RUN_NAME_PATTERN).alias("matched"),
        g(1).try_cast("int").alias("experts"),
        g(2).try_cast("double").alias("rj"),
        g(3).try_cast("double").alias("cf"),
        g(4).try_cast("int").alias("steps"),
    )
