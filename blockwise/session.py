"""Session helpers.

``get_spark`` is for tests, benchmarks and the command line; library code
never creates a session. ``shared_dir`` returns the cluster-wide folder used
for lineage cuts and streaming parts: it is whatever ``spark.checkpoint.dir``
names. Only when that setting is unset on a local master (tests) is a private
folder created and registered; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app: str = "blockwise", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    When unset, as in local tests, a private folder is created and set, so
    later calls in the same session agree.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        # a core setting: it cannot be set on a running session, so the
        # private folder is registered on the context only
        d = tempfile.mkdtemp(prefix="blockwise-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut(df, codec: str | None = None):
    """Cut lineage where an intermediate is read more than once: the frame
    is written once as a parquet table in the shared folder and read back
    (one computation, survives executor loss; ``Dataset.checkpoint`` would
    compute an unpersisted plan twice). ``codec`` names a Parquet codec other
    than the session's, for large tables of text."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path, compression=codec)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of :func:`shared_dir` (never reused)."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
