"""Shards of nearly equal bytes by k-d tree partitioning.

Points are the distinct texts of the corpus, weighted by the bytes of all
their copies; dimensions are metadata (size, language, source, id), each
scaled to 0..1 over the corpus. A node is split along its widest dimension
at the weighted quantile that its two halves should hold (the median where
both have as many shards), until a node is one shard. Ties on a dimension
are ordered by a hash of the text, so a split is never uneven for ties.

The quantile is exact: the 62-bit order key is searched 16 bits at a time,
each step one grouped sum over all points of all nodes of the level; the
driver sees one number per node and step.

Texts heavier than 1 / ``HEAVY`` of a shard (at most shards * HEAVY of them)
would make splits uneven; they are dealt to the emptiest shard first, and
the tree fills up the rest. A text heavier than a whole shard is first cut
by a hash of its ids into pieces. So copies of one text share a shard unless
they don't fit into one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from blockwise.llm.common import cut, utf8

SHARDS = 16
HEAVY = 64
DIMS = ("d_size", "d_lang", "d_source", "d_id")
BUCKET_ROWS = 4096
_STEPS = (46, 30, 14, 0)       # right shifts of the 62-bit key, 16 (last: 14) bits a step


def _points(rows: DataFrame) -> DataFrame:
    unit = lambda c: F.crc32(c) / F.lit(4294967296.0)
    return rows.groupBy("g", "text_crc32", "size", "piece").agg(
        F.sum("size").alias("w"), F.min("lang").alias("lang"), F.min("source").alias("source"),
        F.min("doc_id").alias("doc_id")).select(
        "g", "text_crc32", "size", "piece", "w",
        F.log2(F.col("size")).cast("double").alias("d_size"),
        F.coalesce(unit(F.col("lang")), F.lit(0.0)).alias("d_lang"),
        F.coalesce(unit(F.col("source")), F.lit(0.0)).alias("d_source"),
        F.coalesce(unit(F.col("doc_id").cast("string")), F.lit(0.0)).alias("d_id"),
        F.shiftrightunsigned(F.xxhash64("g", "piece"), 22).alias("tie"))


def _order_key(dim: str):
    return F.shiftleft(F.floor(F.col(dim) * 1048575).cast("long"), 42) + F.col("tie")


def _split_order(dims: dict[int, str]):
    """Order key of a point along the dimension of its node."""
    key = F.lit(None).cast("long")
    for dim in DIMS:
        own = [k for k, c in dims.items() if c == dim]
        if own:
            key = F.when(F.col("node").isin(own), _order_key(dim)).otherwise(key)
    return key


def _per_node(values: dict, kind: str = "long"):
    return F.element_at(F.create_map(*[F.lit(x).cast(t) for k, v in values.items()
                                       for x, t in ((k, "int"), (v, kind))]), F.col("node"))


def _split_points(d: DataFrame, goal: dict[int, float]) -> dict[int, int]:
    """For each node the order key at which the points before it weigh
    ``goal`` bytes (as nearly as a single point allows). ``d``: node, w, key."""
    prefix, before = dict.fromkeys(goal, 0), dict.fromkeys(goal, 0)
    for at, shift in enumerate(_STEPS):
        width = (_STEPS[at - 1] if at else 62) - shift
        part = d.filter(F.shiftright("key", shift + width) == _per_node(prefix))
        digit = F.shiftright("key", shift).bitwiseAND(F.lit((1 << width) - 1))
        sums = part.groupBy("node", digit.alias("digit")).agg(F.sum("w").alias("w"))
        up = Window.partitionBy("node").orderBy("digit")        # at most 65536 digits a node
        cum = sums.select("node", "digit", (F.sum("w").over(up) - F.col("w")).alias("b"))
        need = _per_node({k: float(goal[k] - before[k]) for k in goal}, "double")
        found = cum.filter(F.col("b") <= need).groupBy("node").agg(F.max(F.struct("digit", "b")).alias("x"))
        got = {r["node"]: r["x"] for r in found.collect()}
        for k in goal:
            x = got.get(k)
            prefix[k] = (prefix[k] << width) + (x["digit"] if x else 0)
            before[k] += x["b"] if x else 0
    return prefix


def _kd_leaves(light: DataFrame, room: list[float]) -> DataFrame:
    """``light`` with its shard. ``room``: bytes each shard still takes. One
    written table a level."""
    spans = {0: (0, len(room))}        # node -> shards [lo, hi)
    d = light.withColumn("node", F.lit(0))
    while live := [k for k, (lo, hi) in spans.items() if hi - lo > 1]:
        stat = {r["node"]: r for r in d.filter(F.col("node").isin(live)).groupBy("node").agg(
            F.sum("w").alias("w"), *[(F.max(c) - F.min(c)).alias(c) for c in DIMS]).collect()}
        goal, dim = {}, {}
        for k in live:
            lo, hi = spans[k]
            mid, r = (lo + hi) // 2, stat.get(k)
            left, both = sum(room[lo:mid]), sum(room[lo:hi])
            goal[k] = (left / both if both > 0 else (mid - lo) / (hi - lo)) * (r["w"] if r else 0)
            dim[k] = max(DIMS, key=lambda c: r[c]) if r else DIMS[0]
        d = d.withColumn("key", _split_order(dim))
        at = _split_points(d.filter("key is not null").select("node", "w", "key"), goal)
        d = cut(d.withColumn("node", F.when(F.col("key") < _per_node(at), 2 * F.col("node") + 1)
                             .when(F.col("key").isNotNull(), 2 * F.col("node") + 2)
                             .otherwise(F.col("node"))).drop("key"))
        for k in live:
            lo, hi = spans.pop(k)
            mid = (lo + hi) // 2
            spans[2 * k + 1], spans[2 * k + 2] = (lo, mid), (mid, hi)
    return d.withColumn("shard", _per_node({k: lo for k, (lo, _) in spans.items()}, "int"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                    source: str = "source", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per
    row of ``docs``. size is the text's UTF-8 bytes plus 1 (null counts as
    empty); slots number a shard's rows from 0 in the order of a hash of the
    id. Null languages and sources are values like any other; repeated rows
    are rows of their own; extra columns are not read; an empty table gives
    an empty result."""
    b = utf8(text)
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(b) + 1).cast("long").alias("size"),
        F.crc32(b).alias("text_crc32"), F.xxhash64(b).alias("g"), F.col(lang).alias("lang"),
        F.col(source).alias("source")))
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return _numbered(rows.withColumn("shard", F.lit(0)))
    goal = total / shards
    text_key = ["g", "text_crc32", "size"]
    # texts heavier than a shard: fewer than ``shards`` of them
    whole = rows.groupBy(*text_key).agg(F.sum("size").alias("w")).filter(F.col("w") > goal).collect()
    piece = F.lit(0)
    for r in whole:
        n = int(-(-4 * r["w"] // goal))
        piece = F.when((F.col("g") == r["g"]) & (F.col("text_crc32") == r["text_crc32"]) & (F.col("size") == r["size"]),
                       F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.lit(n)).cast("int")).otherwise(piece)
    rows = rows.withColumn("piece", piece)
    points = _points(rows)
    ext = points.agg(*[f(c).alias(f"{n}_{c}") for c in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for c in DIMS:
        lo, hi = ext[f"lo_{c}"], ext[f"hi_{c}"]
        points = points.withColumn(c, (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0))
    points = cut(points)
    point_key = [*text_key, "piece"]
    heavy = points.filter(F.col("w") > goal / HEAVY).select(*point_key, "w").collect()
    heavy.sort(key=lambda r: (-r["w"], r["g"], r["piece"]))
    load = [(0, k) for k in range(shards)]
    dealt = []
    for r in heavy:         # largest first into the emptiest shard
        w, k = heapq.heappop(load)
        heapq.heappush(load, (w + r["w"], k))
        dealt.append((r["g"], r["text_crc32"], r["size"], r["piece"], k))
    taken = dict((k, w) for w, k in load)
    room = [max(0.0, goal - taken[k]) for k in range(shards)]
    spark = docs.sparkSession
    fixed = spark.createDataFrame(dealt, "g long, text_crc32 long, size long, piece int, own int")
    light = points.filter(F.col("w") <= goal / HEAVY)
    placed = _kd_leaves(light, room).select(*point_key, "shard").union(fixed.select(*point_key, "own"))
    return _numbered(rows.join(placed, point_key))


def _numbered(d: DataFrame) -> DataFrame:
    """Slots by two-level ranks: buckets of a hash of the id within a shard."""
    h = F.xxhash64(F.lit("slot"), "doc_id")
    d = cut(d.select("doc_id", "size", "text_crc32", "shard", h.alias("h")))
    per = d.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    d = d.join(F.broadcast(per), "shard")           # one row per shard
    d = d.withColumn("u", F.shiftrightunsigned("h", 33))
    d = d.withColumn("b", F.shiftright(F.col("u") * F.ceil(F.col("n") / BUCKET_ROWS), 31))
    counts = d.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("shard", "b", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("off"))
    inner = Window.partitionBy("shard", "b").orderBy("u", "h", "doc_id", "size", "text_crc32")
    d = d.join(offs, ["shard", "b"])
    return d.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("off") + F.row_number().over(inner) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
