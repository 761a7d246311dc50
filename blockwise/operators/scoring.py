"""Evaluation and next-token statistics: cross-entropy, capped batch
means, guarded perplexity, a bigram count model fitted and scored as
joins, temperature draws, and the expert feed-forward scorer."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockwise.functions.arrays import cross_entropy, draw, softmax, temper
from blockwise.functions.hashing import hash_uniform
from blockwise.functions.numeric import NAN, perplexity
from blockwise.operators.prefix import _join_on
from blockwise.operators.routing import SLOT_ROWS, dispatch, plan_dispatch
from blockwise.session import cut


def token_ce(df: DataFrame, logits: str = "logits", target: str = "target",
             out: str = "ce") -> DataFrame:
    """Per-row cross-entropy logsumexp(l) - l[target] (F1)."""
    return df.withColumn(out, cross_entropy(logits, target))


def eval_loss(df: DataFrame, batch_size: int, max_batches: int, batch: str = "batch",
              ce: str = "ce") -> DataFrame:
    """Validation loss (F2, F3): mean per batch over full batches only
    (drop-last), then the mean over the first ``max_batches`` batches; one
    row (val_loss, val_ppl, n_batches). No batch gives (NaN, NaN)."""
    per = (df.groupBy(batch).agg(F.avg(ce).alias("_m"), F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") == batch_size))
    # batches are numbered from 0 in order, so 'first m' is batch < m
    per = per.filter(F.col(batch) < max_batches)
    g = per.agg(F.avg("_m").alias("val_loss"), F.count(F.lit(1)).alias("n_batches"))
    loss = F.coalesce(F.col("val_loss"), F.lit(NAN))
    return g.select(loss.alias("val_loss"),
                    F.when(F.col("n_batches") == 0, F.lit(NAN)).otherwise(perplexity(loss))
                    .alias("val_ppl"), "n_batches")


def bigram_pairs(tokens: DataFrame, tok_col: str = "toks",
                 keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keep..., tok, nxt) for every adjacent pair inside a document,
    built by zipping the array with itself shifted (no window)."""
    t = F.col(tok_col)
    n = F.size(t)
    pairs = F.arrays_zip(F.slice(t, 1, F.greatest(n - 1, F.lit(0))).alias("tok"),
                         F.slice(t, 2, F.greatest(n - 1, F.lit(0))).alias("nxt"))
    return tokens.filter(n >= 2).select(*keep, F.inline(pairs))


def fit_bigrams(tokens: DataFrame, tok_col: str = "toks") -> DataFrame:
    """Bigram count model (F4): (tok, nxt, count), partial aggregation."""
    return (bigram_pairs(tokens, tok_col, keep=())
            .groupBy("tok", "nxt").agg(F.count(F.lit(1)).alias("count")))


def score_heldout(tokens: DataFrame, bigrams: DataFrame, smoothing: float = 1.0,
                  tok_col: str = "toks", keep: Sequence[str] = ("doc_id",),
                  n_vocab: int | None = None) -> DataFrame:
    """Per held-out pair (F5): add-k smoothed -ln p(nxt | tok) with
    p = (c(tok, nxt) + k) / (c(tok) + k * V), V = ``n_vocab``, the number of
    tokens that may follow, so p(. | tok) sums to 1 over the vocabulary (by
    default the distinct tokens of the fitted pairs, on either side). Returns
    (keep..., tok, nxt, nll); aggregate with :func:`heldout_loss`. Each
    different pair is looked up and scored once: it meets the bigrams where
    their counting left them, so the model is neither written nor shuffled
    again, and the held-out pairs are shuffled once, to their scores. A null
    is no word: a pair with one is scored, but not counted. All joins are
    equi-joins; AQE splits hot pairs."""
    V = n_vocab
    if V is None:
        bigrams = cut(bigrams)
        V = bigrams.select("tok").union(bigrams.select("nxt")).distinct().count()       # a count
    # the same filter on both readers, so that they share the shuffle of the counting
    bigrams = bigrams.filter("tok is not null and nxt is not null")
    uni = bigrams.groupBy("tok").agg(F.sum("count").alias("_ct"))
    # hashed, not sorted: one row per different held-out pair, the model streams by
    asked = bigram_pairs(tokens, tok_col, ()).distinct().hint("shuffle_hash")
    j = asked.join(bigrams.withColumnRenamed("count", "_cb"), ["tok", "nxt"], "left").join(uni, "tok", "left")
    k = F.lit(float(smoothing))
    prob = (F.coalesce(F.col("_cb"), F.lit(0)) + k) / (F.coalesce(F.col("_ct"), F.lit(0)) + k * F.lit(V))
    scores = j.select("tok", "nxt", (-F.log(prob)).alias("nll"))
    return _join_on(bigram_pairs(tokens, tok_col, keep), scores, ["tok", "nxt"]).select(*keep, "tok", "nxt", "nll")


def heldout_loss(nll: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Mean negative log-likelihood and guarded perplexity per group."""
    g = nll.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("nll").alias("loss"))
    return g.withColumn("ppl", perplexity("loss"))


def temperature_draw(df: DataFrame, t: float, seed: int, key: str = "vec_id",
                     logits: str = "logits") -> DataFrame:
    """Temperature then a seeded categorical draw per row (F6, F7): probs =
    softmax(logits / max(1e-6, t)); u = hash uniform of (seed, key); the
    draw is the first index whose running sum exceeds u."""
    p = softmax(temper(logits, t))
    u = hash_uniform(F.lit(str(seed)), F.col(key))
    return (df.withColumn("_p", p)
              .withColumn("draw", draw("_p", u))
              .withColumn("p_draw", F.element_at("_p", F.col("draw") + 1)).drop("_p"))


# ------------------------------------------------------- expert scorer
FF_BLOCK = 64               # hidden units in one weight block
SLOT_WEIGHT_BYTES = 256 << 20       # weights that one slot is meant to hold


def expert_weights(experts: DataFrame, d_model: int, d_ff: int, seed: int, block: int = FF_BLOCK) -> DataFrame:
    """Seeded weights as a table of blocks of hidden units: (expert, block, w1
    [C x b], b1 [b], w2 [b x C], b2 [C]), matrices row by row, b2 in block 0
    only. Entries are uniform in +-1/sqrt(fan_in) as a linear layer's
    default, each the hash uniform of 'seed:name:expert:index...', so any
    engine with md5 can rebuild them. ``experts`` has a column expert."""
    def entry(name, bound, *index):
        u = hash_uniform(F.lit(str(seed)), F.lit(name), F.col("expert"), *index)
        return (F.lit(2.0) * u - F.lit(1.0)) * F.lit(float(bound))

    def matrix(name, bound, rows, cols):
        return F.flatten(F.transform(rows, lambda i: F.transform(cols, lambda j: entry(name, bound, i, j))))

    lo, hi = F.col("block") * block, F.least((F.col("block") + 1) * block, F.lit(d_ff)) - 1
    own, whole = F.sequence(lo, hi), F.sequence(F.lit(0), F.lit(d_model - 1))
    a1, a2 = 1.0 / np.sqrt(d_model), 1.0 / np.sqrt(d_ff)
    d = experts.select(F.col("expert").cast("int").alias("expert")).distinct().withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(-(-d_ff // block) - 1))))
    bias = F.transform(whole, lambda k: entry("b2", a2, k))
    return d.select("expert", "block", matrix("w1", a1, whole, own).alias("w1"),
                    F.transform(own, lambda j: entry("b1", a1, j)).alias("b1"), matrix("w2", a2, own, whole).alias("w2"),
                    F.when(F.col("block") == 0, bias).otherwise(F.array().cast("array<double>")).alias("b2"))


def expert_block(x: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """w2 . silu(w1 . x + b1) over one block of hidden units (evaluation mode);
    the blocks of an expert add up."""
    h = x @ w1 + b1
    h = h / (1.0 + np.exp(-h))
    return h @ w2


def score_experts(df: DataFrame, weights: DataFrame, key: str = "vec_id", vec: str = "vec",
                  expert: str = "top1", gate: str = "top1_prob", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Expert feed-forward and gate (E11, E12). Rows and weight blocks (see
    :func:`expert_weights`) meet in slots: the rows by the measured dispatch
    plan, the blocks of an expert in every slot that has rows of it, so a hot
    expert's blocks are replicated. A task holds one slot: about ``slot_rows``
    rows and the blocks of its experts. Returns (key, expert, y). Rows routed
    to an expert without weights fail the task."""
    rows = cut(df.select(key, F.col(expert).cast("int").alias(expert), gate, vec))
    weights = cut(weights)
    size = weights.agg(F.sum(F.size("w1") + F.size("w2")).alias("n")).first()[0] or 0
    plan = plan_dispatch(rows, slot_rows, -(-8 * size // SLOT_WEIGHT_BYTES), expert)
    sent = dispatch(rows, plan, key, expert)
    blocks = weights.join(plan.select("expert", "slot").distinct(), "expert")
    kinds = dict(rows.dtypes)
    schema = f"{key} {kinds[key]}, {expert} int, y array<double>"

    def score(table: pa.Table, blocks: pa.Table) -> pa.Table:
        names = [key, expert, "y"]
        if not len(table):      # blocks without rows
            return pa.table([table.column(key), pa.array([], pa.int32()), pa.array([], pa.list_(pa.float64()))], names)
        at: dict = {}
        for i, e in enumerate(blocks.column("expert").to_pylist()):
            at.setdefault(e, []).append(i)
        ids, g = table.column(expert).to_numpy(), table.column(gate).to_numpy()
        flat = table.column(vec).combine_chunks().flatten().to_numpy()
        x = flat.reshape(len(ids), -1).astype("float64")
        y = np.zeros_like(x)
        for e in np.unique(ids):
            if int(e) not in at:
                raise ValueError(f"expert {e} has no weights")
            own = np.flatnonzero(ids == e)
            for i in at[int(e)]:
                w1, b1, w2, b2 = (blocks.column(c)[i].values.to_numpy() for c in ("w1", "b1", "w2", "b2"))
                y[own] += expert_block(x[own], w1.reshape(-1, len(b1)), b1, w2.reshape(len(b1), -1))
                if len(b2):
                    y[own] += b2
        y *= g[:, None]
        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * y.shape[1])
        return pa.table([table.column(key), pa.array(ids, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names)

    return sent.groupBy("slot").cogroup(blocks.groupBy("slot")).applyInArrow(score, schema)
