"""Keys that hold many rows, named by a sketch of the rows themselves, and
rows that cannot match, named by a Bloom filter: what a join needs to know
before it shuffles. Both are built by partial aggregation and have a fixed
size, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from blockwise.session import cut

HOT_KEYS = 1 << 12
BLOOM_BITS = 1 << 23        # 1 MiB
BLOOM_HASHES = 3


def heavy_keys(rows: DataFrame, key: str, k: int = HOT_KEYS) -> DataFrame:
    """(key): the ``k`` most frequent keys of ``rows``, by a mergeable
    frequent-items sketch that tracks 16 times as many. A key left out has
    about one row in ``k`` at most. Null is never named."""
    top = rows.agg(F.expr(f"approx_top_k(`{key}`, {k}, {16 * k})").alias("t"))
    return cut(top.select(F.explode("t").alias("t")).select(F.col("t.item").alias(key)).filter(F.col(key).isNotNull()))


def hot_cold_join(rows: DataFrame, table: DataFrame, key: str, value: str, k: int = HOT_KEYS) -> DataFrame:
    """Left join of ``rows`` with ``table`` (key, value; keys unique): the rows
    of the heavy keys meet a broadcast of at most ``k`` rows of the table,
    found or not, the others are shuffled, none of them hot. ``rows`` is
    written once, so the sketch and both joins read the same rows. Where the
    heavy keys are known from elsewhere, :func:`known_hot_join` writes none."""
    rows = cut(rows)
    hot = cut(heavy_keys(rows, key, k).join(table.select(key, value), key, "left").withColumn("_hot", F.lit(True)))
    j = rows.join(F.broadcast(hot), key, "left")
    cold = j.filter("_hot is null").drop(value, "_hot").join(table.select(key, value), key, "left")
    return j.filter("_hot").select(*rows.columns, value).unionByName(cold.select(*rows.columns, value))


def known_hot_join(rows: DataFrame, table: DataFrame, key: str, value: str, hot: Column) -> DataFrame:
    """The same where ``hot``, a condition on ``key``, holds for the heavy
    keys (and for few rows of ``table``): no sketch is taken and ``rows`` is
    not written, but read by each of the two joins."""
    hot = F.coalesce(hot, F.lit(False))
    table = table.select(key, value)
    j = rows.filter(hot).join(F.broadcast(table.filter(hot)), key, "left")
    return j.unionByName(rows.filter(~hot).join(table.filter(~hot).hint("merge"), key, "left"))


def _places(columns: Sequence[str], bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *columns), F.lit(bits)) for i in range(hashes)]


def bloom_filter(rows: DataFrame, columns: Sequence[str], bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """The Bloom filter of the columns' values as a scalar array of longs,
    evaluated once: ``bits`` bits, set by an aggregation per 64-bit word."""
    at = rows.select(F.explode(F.array(*_places(columns, bits, hashes))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("b"))
    dense = rows.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left")
    whole = dense.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("f"))
    return cut(whole.select(F.transform("f", lambda x: x["b"]).alias("f"))).scalar()


def might_contain(name: str, columns: Sequence[str], bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """Whether the filter in column ``name`` may hold the row's values; never
    false for a value that was put in."""
    hit = F.lit(True)
    for at in _places(columns, bits, hashes):
        word = F.get(F.col(name), F.shiftright(at, 6).cast("int"))
        hit = hit & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return hit


def keep_possible(table: DataFrame, rows: DataFrame, columns: Sequence[str], bits: int = BLOOM_BITS) -> DataFrame:
    """``table`` without most of the rows whose columns match none of ``rows``."""
    d = table.withColumn("_bloom", bloom_filter(rows, columns, bits))
    return d.filter(might_contain("_bloom", columns, bits)).drop("_bloom")
