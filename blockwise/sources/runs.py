"""Run directories: metric logs, configs, metadata and report sinks.

Layout (as written by a training run): ``<root>/<run>/metrics.csv``,
``config.json``, ``meta.json``, ``best_step.txt``. Spark also writes logs
partitioned by run (``<root>/run=<name>/part-*.csv``); both layouts read
back the same way.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from blockwise.functions.numeric import INF, NAN, to_double
from blockwise.session import cut

# The metric log header and its decimals per column.
METRIC_COLUMNS = ["step", "train_loss", "aux", "val_loss", "val_ppl", "tokens_per_sec",
                  "gpu_mem_mb"]
METRIC_DECIMALS = {"train_loss": 6, "aux": 6, "val_loss": 6, "val_ppl": 6,
                   "tokens_per_sec": 2, "gpu_mem_mb": 1}

# the text of a log that has the fixed header (streams read these)
_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in METRIC_COLUMNS])

# The 33 run-config fields with their defaults, in order.
CONFIG_DEFAULTS = {
    "vocab_name": "gpt2", "d_model": 512, "n_layer": 6, "n_head": 8, "seq_len": 256,
    "d_ff": None, "pdrop": 0.0, "moe_layer_index": 3, "moe_num_experts": 8,
    "moe_capacity_factor": None, "moe_router_jitter": 0.0, "moe_all_layers": False,
    "moe_layers": None, "batch_size": 16, "steps": 1500, "lr": 3e-4, "weight_decay": 0.01,
    "grad_clip": 1.0, "bf16": False, "grad_ckpt": False, "device": "cuda",
    "out_dir": "checkpoints/tinystories", "save_every": 0, "max_samples": 200_000,
    "eval_every": 200, "val_batches": 50, "log_csv": True, "no_moe": False, "seed": 42,
    "early_stop_patience": 5, "early_stop_min_delta": 0.0, "early_stop_warmup": 400,
    "max_time_min": None,
}
_CONFIG_TYPES = {
    "vocab_name": T.StringType(), "d_model": T.IntegerType(), "n_layer": T.IntegerType(),
    "n_head": T.IntegerType(), "seq_len": T.IntegerType(), "d_ff": T.IntegerType(),
    "pdrop": T.DoubleType(), "moe_layer_index": T.IntegerType(),
    "moe_num_experts": T.IntegerType(), "moe_capacity_factor": T.DoubleType(),
    "moe_router_jitter": T.DoubleType(), "moe_all_layers": T.BooleanType(),
    "moe_layers": T.StringType(), "batch_size": T.IntegerType(), "steps": T.IntegerType(),
    "lr": T.DoubleType(), "weight_decay": T.DoubleType(), "grad_clip": T.DoubleType(),
    "bf16": T.BooleanType(), "grad_ckpt": T.BooleanType(), "device": T.StringType(),
    "out_dir": T.StringType(), "save_every": T.IntegerType(), "max_samples": T.IntegerType(),
    "eval_every": T.IntegerType(), "val_batches": T.IntegerType(), "log_csv": T.BooleanType(),
    "no_moe": T.BooleanType(), "seed": T.IntegerType(), "early_stop_patience": T.IntegerType(),
    "early_stop_min_delta": T.DoubleType(), "early_stop_warmup": T.IntegerType(),
    "max_time_min": T.IntegerType(),
}
CONFIG_SCHEMA = T.StructType([T.StructField(k, _CONFIG_TYPES[k]) for k in CONFIG_DEFAULTS])

# The architecture fields of the metadata document, in order.
_ARCH_FIELDS = ["d_model", "n_layer", "n_head", "seq_len", "d_ff", "moe_layer_index",
                "moe_layers", "moe_all_layers", "moe_num_experts", "moe_capacity_factor",
                "moe_router_jitter", "pdrop"]
META_SCHEMA = T.StructType([
    T.StructField("enc_name", T.StringType()),
    T.StructField("arch", T.StructType([T.StructField(k, _CONFIG_TYPES[k]) for k in _ARCH_FIELDS])),
    T.StructField("step", T.LongType()),
])

# Run name = the directory holding the file; a 'run=' prefix (Spark's
# partition folders) is dropped.
_RUN_FROM_PATH = r"([^/]+)/[^/]+$"


def _unquoted(c) -> F.Column:
    return F.url_decode(F.regexp_replace(c, r"\+", "%2B"))


def _run_from_path(path_col) -> F.Column:
    """File paths are URIs, and Spark quotes names of partition folders."""
    d = _unquoted(F.regexp_extract(path_col, _RUN_FROM_PATH, 1))
    return F.when(d.startswith("run="), _unquoted(F.substring(d, 5, 1 << 30))).otherwise(d)


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


REPORT = re.compile(r"summary\.csv|router_grid_e\d+\.csv")


def run_inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row per run directory directly under ``root`` (A5), with or
    without a log; only names are listed (one level, driver side). Report
    folders (by their full names) and dot folders are skipped, so
    re-summarising a root is idempotent (A10)."""
    fs, p = _fs(spark, root)
    names = []
    if fs.exists(p):
        for st in fs.listStatus(p):
            n = st.getPath().getName()
            # report folders (summary.csv/, router_grid_e8.csv/) and dot
            # folders are not runs; any other name is
            if not st.isDirectory() or n[:1] == "." or REPORT.fullmatch(n):
                continue
            names.append(unquote(n[4:]) if n.startswith("run=") else n)
    schema = T.StructType([T.StructField("run", T.StringType())])
    return spark.createDataFrame([(n,) for n in sorted(set(names))], schema)


# A run's log as a training run writes it, or as write_metrics writes it
# (Spark partition folders). Report folders (summary.csv/, router_grid_*.csv/)
# hold part files too, so a plain "*/*.csv" would read them as logs.
LOG_GLOB = "{*/metrics.csv,run=*/*.csv}"


def read_runs(spark: SparkSession, root: str, pattern: str = LOG_GLOB, keep_empty: bool = False) -> DataFrame:
    """All metric logs under ``root`` in one table (A4), tagged with the run.
    Columns are taken by each file's own header: a column that a log lacks is
    NaN (a lacking step is NULL), one that is not a metric is not read. The
    header of a file is the line that names metric columns (a data line holds
    numbers only). Numbers are coerced (B10): 'nan'/'inf' parse, unparsable
    text becomes NaN. Zero-byte files give no rows (see run_inventory); a file
    with a header only gives none either, or with ``keep_empty`` one row with
    a NULL step and NaN metrics, so that its run is known to have a log."""
    return parse_log_lines(spark.read.text(f"{root.rstrip('/')}/{pattern}"), keep_empty)


def parse_log_lines(text: DataFrame, keep_empty: bool = False) -> DataFrame:
    """The metric rows of whole log files read as text lines (see
    :func:`read_runs`); works on a table of files and on the new files of a
    stream's batch."""
    lines = text.select(
        F.col("_metadata.file_path").alias("path") if "path" not in text.columns else F.col("path"),
        F.translate("value", '"\r', "").alias("line"))
    # only a line that holds the text of a name is split to be looked at
    names = F.transform(F.split("line", ","), lambda x: F.trim(x))
    may_name = reduce(lambda a, b: a | b, [F.col("line").contains(c) for c in METRIC_COLUMNS])
    is_header = may_name & F.arrays_overlap(names, F.array(*[F.lit(c) for c in METRIC_COLUMNS]))
    # one row per file: the place of every column, -1 where the log lacks it
    headers = lines.filter(is_header).groupBy("path").agg(F.min(names).alias("names"))
    headers = cut(headers.select("path", _run_from_path(F.col("path")).alias("run"), *[(F.array_position("names", c).cast("int") - 1).alias(f"_at_{c}") for c in METRIC_COLUMNS]))
    data = lines.filter(~is_header & (F.trim("line") != ""))
    rows = data.join(headers, "path")
    if keep_empty:
        rows = rows.unionByName(headers.join(data.select("path").distinct(), "path", "left_anti"), allowMissingColumns=True)
    # split once for all columns; a cell that the log or the line lacks is null
    cells = rows.select("run", F.split("line", ",").alias("cells"), *[f"_at_{c}" for c in METRIC_COLUMNS])
    raw = cells.select("run", *[
        F.trim(F.get("cells", F.col(f"_at_{c}"))).alias(c) for c in METRIC_COLUMNS])
    cols = [F.col("step").try_cast("long").alias("step")]
    cols += [F.coalesce(to_double(c), F.lit(NAN)).alias(c) for c in METRIC_COLUMNS[1:]]
    return raw.select("run", *cols)


def _fmt(c: str, d: int) -> F.Column:
    x = F.col(c)
    return (F.when(x.isNull() | F.isnan(x), F.lit("nan"))
             .when(x == F.lit(INF), F.lit("inf"))
             .when(x == F.lit(-INF), F.lit("-inf"))
             .otherwise(F.format_string(f"%.{d}f", x)))


def format_metrics(df: DataFrame) -> DataFrame:
    """Metric columns as the log's text: 6/6/6/6/2/1 decimals, 'nan'/'inf'."""
    return df.select("run", F.col("step").cast("string").alias("step"),
                     *[_fmt(c, d).alias(c) for c, d in METRIC_DECIMALS.items()])


def write_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Metric log sink (A6), one folder per run, overwrite. CSV keeps the
    fixed header and decimals; parquet keeps the doubles. Rows are dealt
    into sampled ranges of (run, step), so a run holding most of the log is
    written by many tasks, each file a sorted step range of one run."""
    w = df.repartitionByRange("run", "step").sortWithinPartitions("run", "step")
    if fmt == "csv":
        (format_metrics(w).write.mode("overwrite").partitionBy("run")
            .option("header", True).csv(path))
    else:
        w.write.mode("overwrite").partitionBy("run").parquet(path)


def read_run_configs(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/*/config.json`` (multi-line JSON) with the run name (A7), or
    what :func:`write_run_configs` wrote under ``root``."""
    return (spark.read.schema(CONFIG_SCHEMA).option("multiLine", True)
            .json(f"{root.rstrip('/')}/{{*/config.json,run=*/*.txt}}")
            .withColumn("run", _run_from_path(F.col("_metadata.file_path"))))


def read_run_meta(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/*/meta.json``: enc_name, nested arch, step (A7), or what
    :func:`write_run_meta` wrote under ``root``."""
    return (spark.read.schema(META_SCHEMA).option("multiLine", True)
            .json(f"{root.rstrip('/')}/{{*/meta.json,run=*/*.txt}}")
            .withColumn("run", _run_from_path(F.col("_metadata.file_path"))))


def read_best_steps(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/*/best_step.txt``: one integer per run, or what
    :func:`write_best_steps` wrote under ``root``."""
    return (spark.read.text(f"{root.rstrip('/')}/{{*/best_step.txt,run=*/*.txt}}")
            .select(_run_from_path(F.col("_metadata.file_path")).alias("run"),
                    F.trim("value").try_cast("long").alias("best_step")))


def meta_json(configs: DataFrame, enc_col: str = "vocab_name", step_col: str = "step") -> DataFrame:
    """(run, json) with the metadata document {enc_name, arch{...}, step}."""
    arch = F.struct(*[F.col(k) for k in _ARCH_FIELDS])
    return configs.select("run", F.to_json(F.struct(F.col(enc_col).alias("enc_name"),
                                                    arch.alias("arch"),
                                                    F.col(step_col).alias("step"))).alias("json"))


def write_run_meta(configs: DataFrame, path: str, step_col: str = "step") -> None:
    """Metadata sink (A7): one JSON document per run under a folder of its own."""
    _write_per_run(meta_json(configs, step_col=step_col).select("run", F.col("json").alias("value")), path)


def write_run_configs(configs: DataFrame, path: str) -> None:
    """Config sink (A7): the 33 fields of each run as one JSON document; a
    NULL field is left out and reads back as NULL."""
    fields = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CONFIG_SCHEMA.fields])
    _write_per_run(configs.select("run", F.to_json(fields).alias("value")), path)


def write_best_steps(best: DataFrame, path: str, col: str = "best_step") -> None:
    """Best-step sink (A7): one integer per run."""
    _write_per_run(best.select("run", F.col(col).cast("long").cast("string").alias("value")), path)


def _write_per_run(rows: DataFrame, path: str) -> None:
    """(run, value), one row per run, as one text file per run."""
    rows.repartition("run").write.mode("overwrite").partitionBy("run").text(path)


def write_summary(summary: DataFrame, root: str) -> str:
    """Summary sink (A8): ``<root>/summary.csv`` folder, header, run order.
    One row per run, so a single file is written."""
    out = f"{root.rstrip('/')}/summary.csv"
    summary.coalesce(1).orderBy("run").write.mode("overwrite").option("header", True).csv(out)
    return out


def write_grid(pivot: DataFrame, root: str, e: int) -> str:
    """Grid sink (A9): ``<root>/router_grid_e{E}.csv`` folder, RJ first."""
    out = f"{root.rstrip('/')}/router_grid_e{e}.csv"
    pivot.coalesce(1).orderBy("rj").write.mode("overwrite").option("header", True).csv(out)
    return out
