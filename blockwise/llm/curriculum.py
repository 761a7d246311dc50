"""Mixing sources to target weights on a time-varying curriculum.

Every source has a weight schedule over training time 0..1 (piecewise
linear). Its integral, scaled to the source's target, is the cumulative
demand for its words. A document takes a stretch of its source's words in a
seeded order; the time at which the demand reaches the middle of that
stretch is its training position. A source whose target exceeds its size is
passed over again. The mixture is the documents range-sorted by position.

Built-in functions only. The running sums are two-level: documents are dealt
into buckets of their source by a hash, bucket totals are summed first, and
a window only ever sees one bucket, so a source with a third of all rows is
spread like any other. The table of sources (one row each) is ordered in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockwise.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5          # words of the mix, as a multiple of all words
MAX_PASSES = 2       # a source gives at most this multiple of its words
# (time, weight) knots, one schedule for each of WEIGHTS: the heavy sources
# fade, the light ones grow
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
BUCKET_ROWS = 4096


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _pieces(knots) -> Column:
    """A schedule as an array of linear pieces, its integral scaled to 1."""
    area = [0.0]
    for (x0, v0), (x1, v1) in zip(knots, knots[1:]):
        area.append(area[-1] + (x1 - x0) * (v0 + v1) / 2)
    if area[-1] <= 0:
        raise ValueError("a schedule needs a positive integral")
    return F.array(*[
        F.struct(F.lit(a / area[-1]).alias("a"), F.lit(x0).alias("x"), F.lit(x1).alias("end"),
                 F.lit(v0 / area[-1]).alias("v"), F.lit((v1 - v0) / (x1 - x0) / area[-1]).alias("s"))
        for a, (x0, v0), (x1, v1) in zip(area, knots, knots[1:])])


def _invert(share: Column, knots) -> Column:
    """Time at which the schedule's integral reaches ``share`` of its whole."""
    def within(at: Column) -> Column:
        rest = share - at["a"]
        root = at["v"] + F.sqrt(F.greatest(F.lit(0.0), at["v"] * at["v"] + 2 * at["s"] * rest))
        return F.least(at["end"], at["x"] + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0)))

    return _let(F.element_at(F.filter(_pieces(knots), lambda p: p["a"] <= share), -1), within)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, n, source_size, k, target) from (source, n, source_size).
    Sources by code point, null last, have ``weights`` in turn (k is the
    index) and share ``share`` times all words; a target stops at
    ``max_passes`` times its source's words and the excess is shared again
    by weight. In order of cap over weight the capped sources come first, so
    one ordered pass finds the level at which none is above."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    d = sizes.withColumn("k", (F.row_number().over(every) - 1) % len(weights))
    d = d.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("k") + 1))
    d = d.withColumn("cap", F.lit(float(max_passes)) * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    up = Window.orderBy("r", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(whole) - before) / still)
    level = F.min_by(F.when(F.col("r") > F.col("level"), F.col("level")),
                     F.when(F.col("r") > F.col("level"), F.col("r"))).over(whole)
    d = d.withColumn("at", level)
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("w")))
    return d.select("source", "n", "source_size", "k", target.alias("target"))


def _sized(docs, id_col, source, text, seed, *more):
    """The narrow columns that a plan needs, and ``more``."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("src"),
        F.col(source).isNull().alias("none"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        F.xxhash64(text).alias("tie"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)


def _placed(base, weights, share, max_passes, schedules, whole):
    sizes = (base.groupBy("src", "none").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
             .withColumn("source", F.when(~F.col("none"), F.col("src"))))
    goals = cut(source_targets(sizes.select("source", "n", "source_size"), weights, share, max_passes)
                .withColumn("src", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
                .drop("source"))
    u = F.shiftrightunsigned("h", 33)       # 31 bits, in the order of buckets
    d = base.join(goals, ["src", "none"]).withColumn("u", u)
    per = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS))
    d = d.withColumn("b", F.shiftright(F.col("u") * per, 31))
    sums = d.groupBy("src", "none", "b").agg(F.sum("size").alias("s"))
    up = Window.partitionBy("src", "none").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "none", "b", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("off"))
    d = d.join(sums, ["src", "none", "b"])
    inner = (Window.partitionBy("src", "none", "b").orderBy("u", "h", "doc_id", "size", "tie")
             .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("start", F.col("off") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    size, goal = F.col("size"), F.col("target")

    def stretch(p: Column) -> Column:
        start = F.col("start") + p * F.col("source_size")
        if whole:
            words = F.when(start + size / 2.0 <= goal, size)
        else:
            words = F.when(start <= goal, F.least(size, F.floor(goal) - start))
        f = F.when(goal > 0, F.least(F.lit(1.0), (start + words / 2.0) / goal)).otherwise(F.lit(0.5))
        return F.struct(words.alias("words"), f.alias("f"))

    passes = F.filter(F.transform(F.array(*[F.lit(p) for p in range(max_passes)]), stretch),
                      lambda x: x["words"].isNotNull() & ((x["words"] > 0) | (size == 0)))

    def position(x: Column) -> Column:
        when = _invert(x["f"], schedules[0])
        for k in range(1, len(weights)):
            when = F.when(F.col("k") == k, _invert(x["f"], schedules[k % len(schedules)])).otherwise(when)
        return when

    d = d.withColumn("passes", passes)
    return d.withColumns({
        "taken": F.aggregate("passes", F.lit(0).cast("long"), lambda acc, x: acc + x["words"]),
        "positions": F.transform("passes", position)})


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
             weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES, schedules=SCHEDULES,
             seed: int = 42, whole: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, positions): one row per row
    of ``docs``, range-sorted by first position (untaken ones last). The
    document in which a source reaches its target is taken up to there; with
    ``whole`` it is taken if the middle of its stretch lies within the
    target, so a source misses its target by half a document at most. Null texts have size 0; the null source is a source; repeated rows are
    rows of their own; extra columns are not read."""
    base = cut(_sized(docs, id_col, source, text, seed))        # small rows, read several times
    d = _placed(base, weights, share, max_passes, schedules, whole)
    d = d.select("doc_id", "size", "source_size", "target", "taken", "positions")
    first = F.get("positions", F.lit(0)).asc_nulls_last()
    return d.repartitionByRange(first, F.col("doc_id")).sortWithinPartitions(first, "doc_id")


def mixture(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
            weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES, schedules=SCHEDULES,
            seed: int = 42) -> DataFrame:
    """The training sequence: the rows of ``docs`` (all columns), once per
    pass that takes them (whole documents only), range-sorted by training
    position. The rows are written once with a number of their own; the plan
    is made from narrow columns, so texts move in two shuffles only."""
    rows = cut(_sized(docs, id_col, source, text, seed, F.struct(*docs.columns).alias("_row"),
                      F.monotonically_increasing_id().alias("rid")))
    d = _placed(rows.drop("_row"), weights, share, max_passes, schedules, True)
    d = d.select("rid", "h", "tie", F.explode("positions").alias("position"))
    d = rows.select("rid", "_row").join(d, "rid")
    order = ["position", "h", "tie"]
    return d.repartitionByRange(*order).sortWithinPartitions(*order).select("_row.*")
