"""A stored corpus and its packed blocks, laid out for the reads they serve:
one folder for each split, rows in order, so a split is a partition filter
and a stretch of documents or blocks prunes files and row groups (A1, C8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockwise.sources.corpus import read_corpus


def _write(df: DataFrame, path: str, order: str) -> None:
    """Sampled ranges of (split, order), sorted: a split of any size is
    written by many tasks, each file a stretch of the order."""
    (df.repartitionByRange("split", order).sortWithinPartitions("split", order)
     .write.mode("overwrite").partitionBy("split").parquet(path))


def write_corpus(docs: DataFrame, path: str) -> None:
    """(split, doc_id, text, ...) by split and document; read it with
    :func:`blockwise.sources.corpus.read_corpus`."""
    _write(docs, path, "doc_id")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """(split, block_id, x, y) by split and block."""
    _write(blocks, path, "block_id")


def read_blocks(spark: SparkSession, path: str, split: str, below: int | None = None) -> DataFrame:
    """The stored blocks of a split, those with an id less than ``below``."""
    b = read_corpus(spark, path, split, columns=("block_id", "x", "y"))
    return b if below is None else b.filter(F.col("block_id") < F.lit(below))


def stored_eval_batches(spark: SparkSession, path: str, split: str, batch_size: int, max_batches: int) -> DataFrame:
    """(batch_id, slot, block_id, x, y): the first ``max_batches`` full
    batches of a split in order (C8). The number of blocks is one count over
    the split's files; after it only the files and row groups of the batches
    are read."""
    n = read_blocks(spark, path, split).count()
    b = read_blocks(spark, path, split, min(max_batches, n // batch_size) * batch_size)
    return b.select(F.floor(F.col("block_id") / batch_size).alias("batch_id"), (F.col("block_id") % batch_size).alias("slot"),
                    "block_id", "x", "y")
