"""Incremental metric ingest (H1) and a live plateau monitor (H2).

Producers write *new* files (parts) per chunk of steps, chunks in step
order, with all of a run's rows of a chunk in one file (e.g.
``repartition('run')`` before the write); the file source only sees whole
new files, never a growing one. The monitor keeps one small
state per run with ``applyInPandasWithState``: (best, best_step,
no_improve, stop_step, last_step, late). Inside a micro-batch a run's rows
are sorted by step; rows at or below the last seen step are late and only
counted. It emits a row whenever the best improves ('best') and once when
the plateau rule fires ('stop'), with the same rule as
:func:`blockwise.operators.stopping.early_stop`.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from blockwise.functions.numeric import NAN, to_double
from blockwise.sources.runs import _TEXT_SCHEMA, LOG_GLOB, _fs, _run_from_path, format_metrics, parse_log_lines

LIVE_GLOB = "batch=*/run=*/*.csv"       # what live_log writes

LOG_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("step", T.LongType()),
    T.StructField("val_ppl", T.DoubleType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("step", T.LongType()),
    T.StructField("event", T.StringType()), T.StructField("best_val", T.DoubleType()),
    T.StructField("best_step", T.LongType()), T.StructField("no_improve", T.LongType()),
])

STATE_SCHEMA = T.StructType([
    T.StructField("best", T.DoubleType()), T.StructField("best_step", T.LongType()),
    T.StructField("no_improve", T.LongType()), T.StructField("stop_step", T.LongType()),
    T.StructField("last_step", T.LongType()), T.StructField("late", T.LongType()),
])


def stream_metrics(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType = LOG_SCHEMA, files_per_batch: int | None = None
                   ) -> DataFrame:
    """Streaming scan of metric parts under ``path`` (H1). ``csv`` reads the
    logs that the sink writes: all columns as text, the run from the path,
    then the columns of ``schema`` by name."""
    r = spark.readStream.schema(_TEXT_SCHEMA if fmt == "csv" else schema).format(fmt)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if fmt != "csv":
        return r.load(path)
    raw = (r.option("header", True).option("enforceSchema", False).load(f"{path.rstrip('/')}/{LOG_GLOB}")
            .withColumn("run", _run_from_path(F.col("_metadata.file_path"))))
    cols = {"run": F.col("run"), "step": F.col("step").try_cast("long")}
    return raw.select(*[cols.get(f.name, F.coalesce(to_double(f.name), F.lit(NAN))).alias(f.name)
                        for f in schema.fields])


def by_step(pdfs, *columns: str) -> list[tuple]:
    """The rows (step, *columns) of a run's frames as plain values in the order
    of steps, rows of one step as they came; times as microseconds. A frame
    holds few rows of many runs, so none is joined, sorted or cast as a frame."""
    rows = []
    for pdf in pdfs:
        taken = [pdf[c].to_numpy() for c in ("step", *columns)]
        rows += zip(*[(x.astype("datetime64[us]").astype("int64") if x.dtype.kind == "M" else x).tolist() for x in taken])
    rows.sort(key=lambda r: (r[0] is None or r[0] != r[0], r[0]))       # a row without a step comes last
    return rows


def plateau_step(patience: int, min_delta: float, warmup: int):
    """The per-run state step: a pure function (key, frames, state)."""
    def step(key, pdfs, state):
        if state.exists:
            best, best_step, no_imp, stop_step, last_step, late = state.get
        else:
            best, best_step, no_imp, stop_step, last_step, late = math.inf, -1, 0, None, 0, 0
        out = []
        for s, v in by_step(pdfs, "val_ppl"):
            if s <= last_step:
                late += 1
                continue
            last_step = s
            if stop_step is not None:
                continue
            if v is not None and v + min_delta < best:
                best, best_step, no_imp = float(v), int(s), 0
                out.append((key[0], s, "best", best, best_step, 0))
            else:
                no_imp += 1
                if s >= warmup and no_imp >= patience:
                    stop_step = s
                    out.append((key[0], s, "stop", best, best_step, no_imp))
        state.update((best, best_step, no_imp, stop_step, last_step, late))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in EVENT_SCHEMA.fields])
    return step


def stream_early_stop(stream: DataFrame, patience: int, min_delta: float,
                      warmup: int) -> DataFrame:
    """Live plateau monitor (H2): 'best' and 'stop' events per run."""
    return stream.groupBy("run").applyInPandasWithState(
        plateau_step(patience, min_delta, warmup), EVENT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout)


def stream_log_lines(spark: SparkSession, root: str, pattern: str = LOG_GLOB,
                     files_per_batch: int | None = None) -> DataFrame:
    """Streaming scan of whole log files under ``root`` as text lines with
    their path: a log's own header is a line like any other, so logs of any
    layout stream together (H1; see :func:`ingest_logs`)."""
    r = spark.readStream
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    lines = r.text(f"{root.rstrip('/')}/{pattern}")
    return lines.select("value", F.col("_metadata.file_path").alias("path"))


def live_log(path: str, fmt: str = "csv"):
    """A ``foreachBatch`` sink (A6 as a live log): each batch is flushed into
    a folder of its own, ``batch=<id>/run=<run>``, sorted by step. A batch
    that was written whole is never written again and one that was not is
    written anew, so a restarted query loses no row and doubles none. One
    query (one checkpoint) writes to one path. Read it back with
    ``read_runs(spark, path, LIVE_GLOB)``."""
    def write(rows: DataFrame, batch_id: int) -> None:
        target = f"{path.rstrip('/')}/batch={batch_id:08d}"
        fs, done = _fs(rows.sparkSession, f"{target}/_SUCCESS")
        if fs.exists(done):
            return
        w = rows.repartitionByRange("run", "step").sortWithinPartitions("run", "step")
        if fmt == "csv":
            format_metrics(w).write.mode("overwrite").partitionBy("run").option("header", True).csv(target)
        else:
            w.write.mode("overwrite").partitionBy("run").parquet(target)

    return write


def ingest_logs(lines: DataFrame, sink, checkpoint: str) -> None:
    """Parse the new files of every batch by their own headers and hand the
    metric rows to ``sink(rows, batch_id)``, until nothing new is there."""
    def each(batch: DataFrame, batch_id: int) -> None:
        sink(parse_log_lines(batch), batch_id)

    (lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def end_step(patience: int, min_delta: float, warmup: int, max_minutes: float | None, eval_every: int, steps: int):
    """The per-run state step of :func:`stream_run_end`."""
    def step(key, pdfs, state):
        best, no_imp, last_step, t0, ended = state.get if state.exists else (math.inf, 0, 0, None, False)
        out = []
        for s, v, t in by_step(pdfs, "val_ppl", "ts"):
            if s <= last_step or ended:
                continue
            last_step, t0 = s, t if t0 is None else min(t0, t)
            if v is not None and v + min_delta < best:
                best, no_imp = float(v), 0
            else:
                no_imp += 1
            reason = None
            if no_imp and s >= warmup and no_imp >= patience:
                reason = "plateau"
            elif max_minutes is not None and eval_every and s % eval_every == 0 and (t - t0) / 1e6 / 60 >= max_minutes:
                reason = "time"
            elif s >= steps:
                reason = "budget"
            if reason:
                ended = True
                out.append((key[0], s, reason))
        state.update((best, no_imp, last_step, t0, ended))
        if out:
            yield pd.DataFrame(out, columns=["run", "step", "reason"])
    return step


END_STATE = "best double, no_improve long, last_step long, t0 long, ended boolean"


def stream_run_end(stream: DataFrame, patience: int, min_delta: float, warmup: int, max_minutes: float | None,
                   eval_every: int, steps: int) -> DataFrame:
    """Live run end (H2 with G15-G17): one row (run, step, reason) when the
    first rule of a run fires: the plateau stop, the time stop (elapsed
    minutes since the run's first row, looked at only at evaluations) or the
    step budget. ``stream`` has (run, step, ts, val_ppl) in the order of
    steps from batch to batch; a late row is ignored. A run that no rule
    ends has no row yet: its end is its last step."""
    return stream.groupBy("run").applyInPandasWithState(
        end_step(patience, min_delta, warmup, max_minutes, eval_every, steps), "run string, step long, reason string",
        END_STATE, "append", GroupStateTimeout.NoTimeout)


def write_chunks(log: DataFrame, path: str, width: int) -> None:
    """Replay a finished log as a producer would write it: parts of ``width``
    steps, in the order of steps, each run's rows of a chunk in one file. The
    number of chunks follows the longest run (one aggregate), so a monitor
    sees at most ``width`` rows of a run in a chunk."""
    last = log.agg(F.max("step")).first()[0] or 0
    for lo in range(0, last, width):
        part = log.filter((F.col("step") > lo) & (F.col("step") <= lo + width))
        part.repartition("run").write.mode("append").parquet(path)


def run_to_end(events: DataFrame, out_path: str, checkpoint: str) -> None:
    """Drive a stream over everything available now, into parquet."""
    q = (events.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
