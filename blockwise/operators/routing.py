"""Top-1 mixture-of-experts routing over a vector table.

Rows carry a vector ``vec ARRAY<DOUBLE>``; the router is a small table
(expert INT, w ARRAY<DOUBLE>, b DOUBLE) with one row per expert, so its
size is bounded by the expert count (checked at run time) and it is
attached to every row as one broadcast array. Logits, softmax, argmax and
balance statistics are array expressions; nothing is exploded per element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockwise.functions.arrays import add_arrays, dot, softmax, top1, top1_prob
from blockwise.functions.hashing import gaussian
from blockwise.operators.hotkeys import hot_cold_join, known_hot_join
from blockwise.operators.prefix import ranged_rank
from blockwise.session import cut

MAX_EXPERTS = 4096        # bound on the broadcast router table
HOT_EMB_ROWS = 1 << 12    # embedding rows broadcast for the most frequent ids
SLOT_ROWS = 1 << 16       # rows that one dispatch slot is meant to hold
MAX_BROADCAST_BYTES = 64 << 20   # a measured vector table up to this is broadcast whole


def experts_row(router: DataFrame) -> DataFrame:
    """The router as one row: ``_experts`` sorted by expert id. Fails at
    run time beyond MAX_EXPERTS rows, so the broadcast stays bounded."""
    few = router.limit(MAX_EXPERTS + 1)     # a larger table is seen without being gathered
    r = few.agg(F.array_sort(F.collect_list(F.struct("expert", "w", "b"))).alias("_experts"))
    return r.withColumn("_experts", F.when(F.size("_experts") <= MAX_EXPERTS, F.col("_experts"))
                        .otherwise(F.raise_error(F.lit("router table too large to broadcast"))))


def router_logits(df: DataFrame, router: DataFrame, vec: str = "vec",
                  out: str = "logits") -> DataFrame:
    """Logits x.w_e + b_e for every expert (E1), in expert order."""
    # the bounded router row as a scalar subquery: evaluated once, shipped
    # with the tasks like a broadcast, no join
    j = df.withColumn("_experts", experts_row(router).select("_experts").scalar())
    lg = F.transform("_experts", lambda e: dot(F.col(vec), e["w"]) + e["b"])
    return j.withColumn(out, lg).drop("_experts")


def add_jitter(df: DataFrame, jitter: float, seed: int, key: str = "vec_id",
               logits: str = "logits") -> DataFrame:
    """logits + j * N(0, 1) when j > 0 (E2); applied in evaluation too. The
    normal draws are hash-based per (seed, row key, expert), so they do not
    depend on partitioning or task retries."""
    if not jitter or jitter <= 0:
        return df
    j = F.lit(float(jitter))
    return df.withColumn(logits, F.transform(
        logits, lambda x, i: x + j * gaussian(F.lit(str(seed)), F.col(key), i)))


def route(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Softmax probabilities, top-1 expert (lowest index on ties) and its
    probability (E3-E5)."""
    return (df.withColumn("probs", softmax(logits))
              .withColumn("top1", top1("probs"))
              .withColumn("top1_prob", top1_prob("probs")))


def router_stats(df: DataFrame, n_experts: int, by: Sequence[str] = ("batch",)) -> DataFrame:
    """Importance (mean probability) and load (share of rows whose top-1 is
    e, before any capacity cap) per group and expert (E6, E7): one
    aggregation with partial combine; long form (by..., expert, importance,
    load)."""
    E = int(n_experts)
    aggs = [F.avg(F.col("probs")[e]).alias(f"_i{e}") for e in range(E)]
    aggs += [F.avg(F.when(F.col("top1") == e, 1.0).otherwise(0.0)).alias(f"_l{e}")
             for e in range(E)]
    g = df.groupBy(*by).agg(*aggs)
    z = F.arrays_zip(F.array(*[F.col(f"_i{e}") for e in range(E)]).alias("importance"),
                     F.array(*[F.col(f"_l{e}") for e in range(E)]).alias("load"))
    return g.select(*by, F.posexplode(z).alias("expert", "_s")).select(
        *by, F.col("expert").cast("int").alias("expert"),
        F.col("_s.importance").alias("importance"), F.col("_s.load").alias("load"))


def aux_loss(stats: DataFrame, n_experts: int, by: Sequence[str] = ("batch",)) -> DataFrame:
    """Balance loss E * sum_e importance_e * load_e per group (E8)."""
    return stats.groupBy(*by).agg(
        (F.lit(float(n_experts)) * F.sum(F.col("importance") * F.col("load"))).alias("aux"))


def total_loss(ce: DataFrame, aux: DataFrame, by: Sequence[str] = ("batch",),
               weight: float = 0.01) -> DataFrame:
    """Sum of balance losses over layers per group, total = ce + 0.01 * aux
    (E14). ``aux`` may hold several rows (layers) per group."""
    a = aux.groupBy(*by).agg(F.sum("aux").alias("aux"))
    return ce.join(a, list(by), "left").withColumn(
        "aux", F.coalesce(F.col("aux"), F.lit(0.0))).withColumn(
        "total", F.col("ce") + F.lit(weight) * F.col("aux"))


def plan_dispatch(rows: DataFrame, target_rows: int = SLOT_ROWS, min_slots: int = 1, expert: str = "top1") -> DataFrame:
    """(expert, salt, salts, slot): where the rows of each expert go, from
    their measured counts (E9). An expert with more than ``target_rows`` rows
    is split into so many salts that none has more; experts at or below it
    are not salted. The units (expert, salt) are dealt out by falling size in
    snake order to as many slots as ``target_rows`` needs (``min_slots`` at
    least), so a slot holds at most the mean and one unit: twice
    ``target_rows``, but for the spread of the salting hash. An expert
    without rows has no unit. One row per unit: experts and slots, not rows."""
    n = rows.groupBy(F.col(expert).alias("expert")).agg(F.count(F.lit(1)).alias("n"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(target_rows))).cast("int")
    n = cut(n.withColumn("salts", salts).withColumn("size", F.ceil(F.col("n") / F.col("salts")).cast("long")))
    total = n.agg(F.sum("n")).first()[0] or 0
    slots = max(1, min_slots, -(-total // target_rows))
    units = n.select("expert", "salts", "size", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    units = ranged_rank(units, [F.col("size").desc(), F.col("expert"), F.col("salt")], out="place")
    turn, at = F.floor(F.col("place") / F.lit(slots)), F.col("place") % slots
    slot = F.when(turn % 2 == 0, at).otherwise(F.lit(slots - 1) - at).cast("int")
    return cut(units.select("expert", "salt", "salts", slot.alias("slot")))


def dispatch(df: DataFrame, plan: DataFrame, key: str = "vec_id", expert: str = "top1") -> DataFrame:
    """Give every row the ``slot`` of its expert (E9): hot experts spread over
    their salts by a hash of ``key``. The plan has one row per unit (experts
    and slots), so the join moves no row unless the plan itself is large."""
    first = plan.filter("salt = 0").select(F.col("expert").alias(expert), "salts")
    salted = df.join(first, expert).withColumn(
        "salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64(F.col(key)), F.col("salts"))).otherwise(0).cast("int"))
    where = plan.select(F.col("expert").alias(expert), "salt", "slot")
    return salted.join(where, [expert, "salt"]).select(*df.columns, "slot")


def apply_capacity(df: DataFrame, capacity_factor: float | None, n_experts: int,
                   order: Sequence[str] = ("vec_id",), by: Sequence[str] = ("batch",),
                   expert: str = "top1") -> DataFrame:
    """Capacity cap (E10): per group, cap = ceil(cf * rows / E); each
    expert keeps its first ``cap`` rows in ``order``; ``None`` keeps all
    and 0 drops all. Adds ``kept``. A window group is one expert of one
    batch, bounded by the batch size."""
    if capacity_factor is None:
        return df.withColumn("kept", F.lit(True))
    by = list(by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    cap = F.ceil(F.lit(float(capacity_factor)) * F.col("_rows") / F.lit(float(n_experts)))
    w = Window.partitionBy(*by, expert).orderBy(*order)
    return (df.join(n, by).withColumn("_rn", F.row_number().over(w))
              .withColumn("kept", F.col("_rn") <= cap).drop("_rn", "_rows"))


def dispatch_report(df: DataFrame, by: str = "batch", expert: str = "top1") -> DataFrame:
    """Dispatch health (E15): routed, kept, dropped and drop rate per
    (group, expert), per expert over all groups and overall, in one
    grouping-sets aggregation. ``level`` names the grouping
    ('batch_expert', 'expert', 'all'); ids rolled up are -1."""
    d = df.select(F.col(by).alias("batch"), F.col(expert).alias("expert"),
                  F.col("kept").cast("int").alias("_k"))
    k = F.col("_k")
    g = d.groupingSets([["batch", "expert"], ["expert"], []], "batch", "expert").agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("routed"), F.sum(k).cast("long").alias("kept"),
        (F.count(F.lit(1)) - F.sum(k)).cast("long").alias("dropped"),
        ((F.count(F.lit(1)) - F.sum(k)) / F.count(F.lit(1))).alias("drop_rate"))
    level = (F.when(F.col("_gid") == 0, F.lit("batch_expert"))
              .when(F.col("_gid") == 2, F.lit("expert")).otherwise(F.lit("all")))
    return g.select(level.alias("level"),
                    F.coalesce(F.col("batch"), F.lit(-1)).cast("long").alias("batch"),
                    F.coalesce(F.col("expert"), F.lit(-1)).cast("int").alias("expert"),
                    "routed", "kept", "dropped", "drop_rate")


def combine(x: DataFrame, y: DataFrame, key: str = "vec_id", vec: str = "vec",
            out: str = "out") -> DataFrame:
    """Scatter expert outputs back over all rows (D4, E13): rows without an
    output (dropped by the cap, or never routed) get zeros, so the residual
    ``x + y`` passes them unchanged."""
    j = x.join(y.select(key, F.col("y").alias("_y")), key, "left")
    zeros = F.array_repeat(F.lit(0.0), F.size(vec))
    return j.withColumn(out, add_arrays(vec, F.coalesce(F.col("_y"), zeros))).drop("_y")


def table_bytes(df: DataFrame, vec: str = "vec") -> int:
    """Measured size of a vector table, rows x widest vector x 8 bytes
    (one aggregate; a count)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("w")).collect()[0]
    return int(r["n"] or 0) * int(r["w"] or 0) * 8


def _position_table(pos_emb: DataFrame, seq_len: int, pos_col: str) -> tuple[Column, list[int]] | None:
    """The vectors of positions 0 to seq_len - 1 as one array (evaluated once)
    and the positions that have none; None when a position has several."""
    rows = pos_emb.filter(F.col(pos_col).between(0, seq_len - 1))
    n = {r[0]: r[1] for r in rows.groupBy(pos_col).count().collect()}     # at most seq_len
    if any(k > 1 for k in n.values()):
        return None
    every = pos_emb.sparkSession.range(seq_len).select(F.col("id").alias(pos_col)).join(rows, pos_col, "left")
    one = every.agg(F.array_sort(F.collect_list(F.struct(pos_col, F.col("pvec").alias("vec")))).alias("p"))
    return one.scalar(), [p for p in range(seq_len) if p not in n]


def embed_tokens(tokens: DataFrame, emb: DataFrame, pos_emb: DataFrame, seq_len: int,
                 id_col: str = "emb_id", pos_col: str = "pos", out: str = "x",
                 hot_rows: int = HOT_EMB_ROWS,
                 max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                 value: Callable[[Column], Column] | None = None,
                 frequent: Callable[[int], Column] | None = None) -> DataFrame:
    """Token vector + position vector (D1, D2). ``pos_emb`` (pos, pvec) has
    at most ``seq_len`` rows and is broadcast; positions >= seq_len fail the
    job. ``emb`` (emb_id, vec) grows with the vocabulary: its size is
    measured first and, within ``max_broadcast_bytes``, it is broadcast
    whole (one pass over the tokens). Beyond that a sketch of the tokens
    names their ``hot_rows`` most frequent ids, the end marker's included,
    whose rows are broadcast; the other tokens, none of which is hot, are
    joined with a shuffle. The tokens are written once for that, one row
    each; with ``frequent`` they are not: called with the number of vectors
    that fill ``max_broadcast_bytes`` (``hot_rows`` at least), it gives a
    condition that at most so many ids meet, the most frequent ones among
    them, and that takes the sketch's place. A token whose id or position has
    no row fails the job.

    With ``value``, ``out`` is that function (one number) of the vector sum.
    It depends on the id and the position alone, so the vectors are added
    once for every row of ``emb`` and each position, and a token takes the
    number of its id and position instead of 2 vectors."""
    def found(c, there, what):
        return F.when(there, c).otherwise(F.raise_error(F.lit(f"{what} without a vector")))

    t = tokens.withColumn(pos_col, F.when(F.col(pos_col) < seq_len, F.col(pos_col)).otherwise(
        F.raise_error(F.lit("position beyond seq_len")).cast("long")))
    table = _position_table(pos_emb, seq_len, pos_col) if value else None
    if table:
        positions, missing = table
        e = emb.withColumn("_p", positions)
        e = cut(e.select(id_col, F.transform("_p", lambda p: value(add_arrays(F.col("vec"), p["vec"]))).alias("vec")))
        size = table_bytes(e)
    else:
        e, size = emb, table_bytes(emb)
    e = e.select(F.col(id_col), F.struct("vec").alias("_tv"))
    if size <= max_broadcast_bytes:
        j = t.join(F.broadcast(e), id_col, "left")
    elif frequent:
        # no id is null from here on, so both branches read the same join of tokens and ids
        t = t.withColumn(id_col, found(F.col(id_col), F.col(id_col).isNotNull(), "token id"))
        j = known_hot_join(t, e, id_col, "_tv", frequent(max(hot_rows, max_broadcast_bytes * e.count() // size)))
    else:
        j = hot_cold_join(t, e, id_col, "_tv", hot_rows)
    tv = found(F.col("_tv")["vec"], F.col("_tv").isNotNull(), "token id")
    if table:
        at = F.get(tv, F.col(pos_col).cast("int"))
        there = F.col(pos_col) >= 0
        return j.withColumn(out, found(at, there & ~F.col(pos_col).isin(missing) if missing else there, "position")).drop("_tv")
    j = j.join(F.broadcast(pos_emb.select(pos_col, F.struct(F.col("pvec").alias("vec")).alias("_pv"))), pos_col, "left")
    pv = found(F.col("_pv")["vec"], F.col("_pv").isNotNull(), "position")
    x = add_arrays(tv, pv)
    return j.withColumn(out, value(x) if value else x).drop("_tv", "_pv")
