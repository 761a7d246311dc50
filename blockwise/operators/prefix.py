"""Ordered computations without a single-partition window.

A plain ``OVER (ORDER BY x)`` (or ``PARTITION BY key`` on a hot key) puts
every row of the order in one task. :func:`ordered_scan` computes a running
value of any associative operator (sum, minimum, last value, ...) over any
order:

1. the rows are dealt into ranges of the order, cut by a sample of the keys,
   and written once (:func:`ranged`), so ranges follow the rows whatever the
   keys look like and retries agree;
2. one small row per key and range (the operator's total), with partial
   aggregation;
3. an exclusive scan over the ranges' totals. A key reaches at most as many
   ranges as there are; beyond ``fan`` of them the totals are scanned in the
   same way, ``fan`` at a time, level by level, so no task sees more than
   ``fan`` totals of a key;
4. a join back on key and range, and a window partitioned by both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockwise.session import cut

_R = "_rng"
FAN = 1024


@dataclass(frozen=True)
class Operator:
    """An associative operator whose identity is null. ``total`` aggregates
    the values of a group given their order, ``running`` the same over an
    ordered window, ``join`` puts two results together, the earlier first."""
    total: Callable[[Column, Column], Column]
    running: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


SUM = Operator(lambda v, o: F.sum(v), F.sum, lambda a, b: F.coalesce(a + b, a, b))
MIN = Operator(lambda v, o: F.min(v), F.min, F.least)
LAST = Operator(lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)), lambda v: F.last(v, ignorenulls=True),
                lambda a, b: F.coalesce(b, a))


def _rename(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in names})


def _join_on(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on ``names``, null equal to null; ``right`` gives its other columns."""
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return left.join(_rename(right, names, "_k_"), same).drop(*[f"_k_{c}" for c in names])


def ranged(df: DataFrame, order_cols: Sequence) -> DataFrame:
    """``df`` dealt into ranges of the order, written once, with the range
    number in ``_rng``. Ranges are cut by a sample of the keys, so their sizes
    follow the rows whatever the keys look like (sparse, dense, one hot key);
    the written table keeps the cut points, so retries agree."""
    return cut(df.repartitionByRange(*order_cols).withColumn(_R, F.spark_partition_id()))


def n_ranges(df: DataFrame) -> int:
    """The most ranges that :func:`ranged` makes in this session."""
    conf = df.sparkSession.conf
    first = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(conf.get("spark.sql.shuffle.partitions")), int(first or 0))


def carried(totals: DataFrame, part: Sequence[str], ops: dict[str, Operator], ranges: int, fan: int = FAN) -> DataFrame:
    """(*part, _rng, *ops): what the ranges before each one add up to (null
    before the first), from (*part, _rng, *ops) of one row per key and range."""
    part = list(part)
    before = Window.orderBy(_R).rowsBetween(Window.unboundedPreceding, -1)
    if ranges <= fan:
        w = before.partitionBy(*part)
        return totals.select(*part, _R, *[op.running(F.col(c)).over(w).alias(c) for c, op in ops.items()])
    d = totals.withColumn("_up", F.floor(F.col(_R) / F.lit(fan)).cast("int"))
    upper = d.groupBy(*part, F.col("_up").alias(_R + "u")).agg(
        *[op.total(F.col(c), F.col(_R)).alias(c) for c, op in ops.items()]).withColumnRenamed(_R + "u", _R)
    upper = carried(cut(upper), part, ops, -(-ranges // fan), fan).withColumnRenamed(_R, "_up")
    w = before.partitionBy(*part, "_up")
    inner = d.select(*part, "_up", _R, *[op.running(F.col(c)).over(w).alias(f"_i_{c}") for c, op in ops.items()])
    j = _join_on(inner, upper, [*part, "_up"])
    return j.select(*part, _R, *[op.join(F.col(c), F.col(f"_i_{c}")).alias(c) for c, op in ops.items()])


def ordered_scan(df: DataFrame, order_cols: Sequence, values: dict[str, tuple[Operator, Column]],
                 partition_cols: Sequence[str] = (), inclusive: bool = True, whole: dict[str, str] | None = None,
                 fan: int = FAN) -> DataFrame:
    """Add one column for each of ``values`` ({name: (operator, value)}): the
    operator over the rows up to this one in ``order_cols`` within
    ``partition_cols`` (``inclusive=False``: over the rows before it; null
    where there are none). ``whole`` adds {name: column}, the operator over
    the whole partition. Null keys are keys like any other; ties of the
    order are broken arbitrarily but once and for all."""
    part = list(partition_cols)
    ops = {f"_s_{c}": op for c, (op, _) in values.items()}
    d = ranged(df.withColumns({f"_v_{c}": v for c, (_, v) in values.items()}), [*part, *order_cols])
    place = F.struct(*[F.col(c) for c in order_cols if isinstance(c, str)])
    totals = d.groupBy(*part, _R).agg(*[op.total(F.col(f"_v_{c}"), place).alias(f"_s_{c}") for c, (op, _) in values.items()])
    offsets = carried(totals, part, ops, n_ranges(df), fan)
    if whole:
        sums = totals.groupBy(*part).agg(*[values[c][0].total(F.col(f"_s_{c}"), F.col(_R)).alias(out) for out, c in whole.items()])
        offsets = _join_on(offsets, sums, part)
    # written, so their size is known when the join is planned: where they are few, the rows are not shuffled for it
    j = _join_on(d, cut(offsets), [*part, _R])
    last = 0 if inclusive else -1
    w = Window.partitionBy(*part, _R).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, last)
    out = {c: op.join(F.col(f"_s_{c}"), op.running(F.col(f"_v_{c}")).over(w)) for c, (op, _) in values.items()}
    return j.withColumns(out).drop(_R, *[f"_v_{c}" for c in values], *[f"_s_{c}" for c in values])


def ranged_rank(df: DataFrame, order_cols: Sequence, partition_cols: Sequence[str] = (),
                out: str = "rank", fan: int = FAN) -> DataFrame:
    """Add ``out``: 0-based position of each row in ``order_cols`` order within
    ``partition_cols`` (null is a key like any other). A key has as many
    counts as ranges it reaches, so a key with any share of the rows is
    ranked by many tasks."""
    d = ordered_scan(df, order_cols, {out: (SUM, F.lit(1))}, partition_cols, fan=fan)
    return d.withColumn(out, (F.col(out) - 1).cast("long"))
