"""Corpus scan (A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_corpus(spark: SparkSession, path: str, split: str | None = None,
                fmt: str = "parquet", columns=("doc_id", "split", "text")) -> DataFrame:
    """Scan a corpus with columns (doc_id, split, text); only the named
    columns are read and the split filter reaches the scan."""
    df = spark.read.format(fmt).load(path)
    if split is not None:
        df = df.filter(F.col("split") == F.lit(split))
    return df.select(*columns)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows out (into ``spark.sql.shuffle.partitions``) only when
    the scan yields fewer partitions than that and they are fewer than the
    default parallelism or unequal: one has more than twice an even share of
    the cores (e.g. one large row group holding a whole table). A large
    input already has enough splits and is left alone, so no extra shuffle
    happens at scale. The rows of a partition are counted from the files'
    footers. The key is hashed and salted, so the result reports no
    partitioning by ``key`` and no session setting is touched."""
    spark = df.sparkSession
    n, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    if parts >= max(n, cores):
        return df
    if parts >= cores:
        rows = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
        if (rows[0] or 0) * cores <= 2 * (rows[1] or 0):
            return df
    return df.repartition(n, F.xxhash64(F.lit("spread"), F.col(key)))
