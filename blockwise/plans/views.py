"""Derived views over the driver tables. Each has the same definition in
:mod:`blockwise.plans.oracle` (DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockwise.functions.numeric import INF, NAN, every_k
from blockwise.operators.corpus import EOS_TOKEN, check_special, tokenize_words
from blockwise.operators.prefix import ranged_rank
from blockwise.operators.runs import sweep_rows
from blockwise.sources.corpus import spread

# Fixed values of the study layout.
SEQ_LEN = 256          # block length L
BATCH = 16             # blocks per batch B
SEED = 42
VAL_BATCHES = 50
STEPS = 1500           # training steps of the schedule
SWEEP_STEPS = 10000    # the steps part of sweep run names
EVAL_EVERY = 20        # evaluation interval of grid_log
VEC_BATCH = 100        # vectors per routing batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """documents with split = 'validation' when doc_id % 10 = 0, else 'train'.
    ``place`` adds ``file`` and ``row``, where a row stands in the table's
    files: they tell rows apart whatever these hold."""
    d = table(spark, sf_dir, "documents")
    at = ["file", "row"] if place else []
    if place:
        d = d.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    d = spread(d, "doc_id")
    split = F.when(F.col("doc_id") % 10 == 0, F.lit("validation")).otherwise(F.lit("train"))
    return d.select("doc_id", split.alias("split"), "text", "lang", "source", *at)


def tokens(spark: SparkSession, sf_dir: str, eos: bool = True) -> DataFrame:
    """(doc_id, split, lang, source, toks) word tokens, '<eos>' appended."""
    c = corpus(spark, sf_dir).select("doc_id", "split", "lang", "source", "text")
    if eos:     # a typed marker would pass for an appended one
        c = check_special(c, [EOS_TOKEN], whole=True)
    return tokenize_words(c, eos=EOS_TOKEN if eos else None).drop("text")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a metric log: one run per user, steps numbered by (ts,
    event_id), error -> inf ppl, signup -> NaN ppl."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = ev.withColumn("run", F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    ranked = ranged_rank(ev, ["ts", "event_id"], ["run"], out="_r")
    return _metrics(ranked.withColumn("step", F.col("_r") + 1).drop("_r"))


def _metrics(ev: DataFrame) -> DataFrame:
    et, v = F.col("event_type"), F.col("value")
    ppl = (F.when(et == "error", F.lit(INF)).when(et == "signup", F.lit(NAN))
            .otherwise(v.cast("double")))
    return ev.select(
        "run", F.col("step").cast("long").alias("step"), "ts",
        F.log(F.lit(1.0) + v).alias("train_loss"),
        (v / F.lit(100.0)).alias("aux"),
        F.log(ppl).alias("val_loss"),
        ppl.alias("val_ppl"),
        (v * F.lit(100.0)).alias("tokens_per_sec"),
        F.when(et == "view", F.lit(NAN)).otherwise(F.round(v * F.lit(8.0), 1)).alias("gpu_mem_mb"),
    )


def sweep_names() -> list[str]:
    """The 13 run names of the full sweep, in launch order."""
    return [r[1] for r in sweep_rows(SWEEP_STEPS)]


def grid_log(spark: SparkSession, sf_dir: str, run_names: list[str] | None = None) -> DataFrame:
    """events as the logs of the 13 sweep runs, or of ``run_names`` (run =
    name number user_id % their count), steps numbered per run by (ts,
    event_id); validation columns only at evaluation steps (step % 20 = 0),
    NULL elsewhere."""
    run_names = run_names or sweep_names()
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    names = F.array(*[F.lit(n) for n in run_names])
    ev = ev.withColumn("run", F.element_at(names, (F.col("user_id") % len(run_names)).cast("int") + 1))
    ranked = ranged_rank(ev, ["ts", "event_id"], ["run"], out="_r")
    m = _metrics(ranked.withColumn("step", F.col("_r") + 1).drop("_r"))
    is_eval = every_k("step", EVAL_EVERY)
    return (m.withColumn("val_loss", F.when(is_eval, F.col("val_loss")))
             .withColumn("val_ppl", F.when(is_eval, F.col("val_ppl"))))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with batch = vec_id div 100 (row order = vec_id)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("vec_id") / VEC_BATCH).cast("long").alias("batch"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expert per label: weights = per-dimension mean of its embeddings,
    rounded to 6 places; bias 0. (expert INT, w ARRAY<DOUBLE>, b DOUBLE)."""
    e = table(spark, sf_dir, "embeddings")
    ex = e.select("label", F.posexplode("embedding").alias("i", "x"))
    m = ex.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("w"))
    g = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("_p"))
    return g.select(F.col("label").cast("int").alias("expert"),
                    F.transform("_p", lambda s: s["w"]).alias("w"), F.lit(0.0).alias("b"))
