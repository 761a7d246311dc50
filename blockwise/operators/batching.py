"""Seeded per-epoch shuffles, batch assignment, the step schedule and
sequential evaluation batches. A batch is a key (epoch, batch_id) over
block ids, never an object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from blockwise.operators.prefix import ranged_rank


def shuffle_key(seed: int, epoch, block_id) -> F.Column:
    """md5('seed:epoch:block_id'): the order key of a block in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                             block_id.cast("string")))


def shuffle_blocks(blocks: DataFrame, seed: int, epochs: int | None = None,
                   partition_cols: Sequence[str] = ("split",)) -> DataFrame:
    """Per-epoch seeded permutation (C5). ``blocks`` has block ids and,
    unless ``epochs`` is given, an ``epoch`` column; with ``epochs`` each
    block is repeated for epochs 0..epochs-1. Adds ``rank`` (0-based
    position in the epoch), ordered by (md5 key, block_id)."""
    part = list(partition_cols)
    b = blocks
    if epochs is not None:
        b = b.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    b = b.withColumn("_key", shuffle_key(seed, F.col("epoch"), F.col("block_id")))
    return ranged_rank(b, ["_key", "block_id"], [*part, "epoch"]).drop("_key")


def assign_batches(ranked: DataFrame, batch_size: int,
                   partition_cols: Sequence[str] = ("split",)) -> DataFrame:
    """batch_id = rank div B, slot = rank % B; the last short batch is
    dropped (C6). Needs ``epoch`` and ``rank``."""
    part = list(partition_cols)
    B = int(batch_size)
    n = ranked.groupBy(*part, "epoch").agg(F.count(F.lit(1)).alias("_n"))
    r = ranked.join(n, on=[*part, "epoch"])
    return (r.withColumn("batch_id", (F.col("rank") / F.lit(B)).cast("long"))
             .withColumn("slot", (F.col("rank") % F.lit(B)).cast("long"))
             .filter(F.col("batch_id") < (F.col("_n") / F.lit(B)).cast("long"))
             .drop("_n"))


def schedule(blocks: DataFrame, steps: int, batch_size: int, seed: int,
             partition_cols: Sequence[str] = ("split",)) -> DataFrame:
    """Step schedule (C7): steps 0..steps-1 walk the shuffled batches of
    epoch 0, 1, ...; the last epoch stops mid-way. Rows (step, epoch,
    batch_id, slot, block_id). Zero batches raise at run time (the
    reference would loop forever)."""
    part = list(partition_cols)
    B = int(batch_size)
    nb = (blocks.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_nb", (F.col("_n") / F.lit(B)).cast("long"))
                .withColumn("_nb", F.when(F.col("_nb") > 0, F.col("_nb")).otherwise(
                    F.raise_error(F.lit("schedule: fewer blocks than one batch")).cast("long")))
                .withColumn("_epochs", F.ceil(F.lit(steps) / F.col("_nb")).cast("int"))
                .drop("_n"))
    b = blocks.join(nb.select(*part, "_epochs"), on=part)
    b = b.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1))).drop("_epochs")
    batches = assign_batches(shuffle_blocks(b, seed, None, part), B, part)
    st = (nb.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"),
                                                     F.lit(steps - 1).cast("long"))))
            .withColumn("epoch", (F.col("step") / F.col("_nb")).cast("int"))
            .withColumn("batch_id", (F.col("step") % F.col("_nb")).cast("long"))
            .select(*part, "step", "epoch", "batch_id"))
    return st.join(batches, on=[*part, "epoch", "batch_id"]).select(
        *part, "step", "epoch", "batch_id", "slot", "block_id")


def eval_batches(blocks: DataFrame, batch_size: int, max_batches: int,
                 partition_cols: Sequence[str] = ("split",)) -> DataFrame:
    """Sequential evaluation batches (C8): batch_id = block_id div B, no
    shuffle, only the first min(max_batches, n div B) full batches."""
    part = list(partition_cols)
    B = int(batch_size)
    n = blocks.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    lim = F.least(F.lit(max_batches).cast("long"), (F.col("_n") / F.lit(B)).cast("long"))
    return (blocks.join(n, on=part)
                  .withColumn("batch_id", (F.col("block_id") / F.lit(B)).cast("long"))
                  .withColumn("slot", (F.col("block_id") % F.lit(B)).cast("long"))
                  .filter(F.col("batch_id") < lim).drop("_n"))


def block_ids(docs: DataFrame, seq_len: int,
              partition_cols: Sequence[str] = ("split",)) -> DataFrame:
    """Block ids 0..n_blocks-1 per split without the token data: each
    document (with ``start``, ``n``, ``total`` from ``token_offsets``)
    emits the blocks whose first position falls inside it, so the ids are
    generated in parallel across documents, never from one row."""
    from blockwise.operators.corpus import n_blocks
    L = int(seq_len)
    part = list(partition_cols)
    start, n = F.col("start"), F.col("n")
    first = ((start + L - 1) / F.lit(L)).cast("long")              # ceil(start / L)
    last = F.least(((start + n - 1) / F.lit(L)).cast("long"), n_blocks(F.col("total"), L) - 1)
    return (docs.filter((n > 0) & (last >= first))
                .select(*part, F.explode(F.sequence(first, last)).alias("block_id")))
