"""Run analytics over metric logs (run STRING, step LONG, metric DOUBLEs):
forward fill, best step, run summary, baseline comparison, sweep grid,
curves, the sweep table and config normalisation.

Every per-run statistic is one ``groupBy('run')`` with partial
aggregation, so a run holding a third of all rows is combined map-side;
ordered passes use the two-level helpers of :mod:`prefix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockwise.functions.names import parse_run_name
from blockwise.functions.numeric import NAN, every_k, is_finite, nan_max, not_missing
from blockwise.operators.prefix import LAST, ordered_scan
from blockwise.session import cut
from blockwise.sources.runs import CONFIG_DEFAULTS, CONFIG_SCHEMA

def eval_points(df: DataFrame, k: int, step_col: str = "step") -> DataFrame:
    """Rows with ``step % k == 0`` (G2, G19); k = 0 keeps none."""
    return df.filter(every_k(step_col, k))


def ffill_eval(df: DataFrame, cols: Sequence[str] = ("val_loss", "val_ppl")) -> DataFrame:
    """Forward fill validation metrics between evaluations (G1): a
    non-evaluation step is NULL; it takes the last evaluated value (NaN
    results are carried) and NaN before the first evaluation. A run's rows
    are filled over sampled ranges of (run, step)."""
    f = ordered_scan(df, ["step"], {f"_f_{c}": (LAST, F.col(c)) for c in cols}, ["run"])
    return f.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.lit(NAN)) for c in cols}).drop(*[f"_f_{c}" for c in cols])


def best_step(df: DataFrame, mode: str = "finite", col: str = "val_ppl") -> DataFrame:
    """Best step per run; ties go to the lowest step.

    ``finite`` (G3): only finite values; (NaN, NaN) when none.
    ``notna`` (G4): NaN dropped, inf kept; (NaN, -1) when none.
    """
    v = F.col(col)
    keep = is_finite(v) if mode == "finite" else not_missing(v)
    key = F.when(keep, F.struct(v.alias("v"), F.col("step").alias("s")))
    g = df.groupBy("run").agg(F.min(key).alias("_b"))
    best = F.coalesce(F.col("_b.v"), F.lit(NAN))
    if mode == "finite":
        st = F.coalesce(F.col("_b.s").cast("double"), F.lit(NAN))
    elif mode == "notna":
        st = F.coalesce(F.col("_b.s"), F.lit(-1)).cast("long")
    else:
        raise ValueError(mode)
    return g.select("run", best.alias("best_val_ppl"), st.alias("best_step"))


SUMMARY_COLUMNS = ["run", "final_val_ppl", "best_val_ppl", "best_step", "last_train_loss",
                   "max_tok_s", "peak_mem_mb"]


def summarize_runs(log: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Run summary (G5-G8), one aggregation per run:
    final = last finite val_ppl by step; best / best_step as G3; last
    train_loss of the last row (no filter); max tokens/s and peak memory
    skipping NaN. Runs of ``inventory`` without rows get an all-NaN row."""
    return summary_of(run_facts(log, inventory))


def summary_of(facts: DataFrame) -> DataFrame:
    """The summary's columns of :func:`run_facts`, NaN where there is nothing."""
    return facts.select("run", *[F.coalesce(F.col(c), F.lit(NAN)).alias(c) for c in SUMMARY_COLUMNS[1:]])


def run_facts(log: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """What every report on runs is made of, in one aggregation of the log:
    the summary's columns (null where there is nothing), ``kept``: the best
    (value, step) by the not-missing rule (G4), and ``rows``. Written once,
    it serves the summary, the baseline comparison and the grid."""
    v, s = F.col("val_ppl"), F.col("step")
    fin = is_finite(v)
    g = log.groupBy("run").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.when(not_missing(v), F.struct(v.alias("v"), s.alias("s")))).alias("kept"),
        F.max_by(F.when(fin, v), F.when(fin, s)).alias("final_val_ppl"),
        F.min(F.when(fin, F.struct(v.alias("v"), s.alias("s")))).alias("_b"),
        F.max_by(F.col("train_loss"), s).alias("last_train_loss"),
        nan_max("tokens_per_sec").alias("max_tok_s"),
        nan_max("gpu_mem_mb").alias("peak_mem_mb"))
    g = g.select("run", "final_val_ppl", F.col("_b.v").alias("best_val_ppl"),
                 F.col("_b.s").cast("double").alias("best_step"),
                 "last_train_loss", "max_tok_s", "peak_mem_mb", "kept", "rows")
    if inventory is not None:
        g = inventory.select("run").join(g, "run", "left")
    return g


def vs_baseline(summary: DataFrame, marker: str = "baseline") -> DataFrame:
    """Improvement over the baseline (G9, D5): the baseline is the last run
    in name order whose name contains ``marker``; its **final** ppl is
    used. The column is NULL when there is no baseline or its final ppl is
    not finite (the schema stays the same). The summary, one row per run, is
    written once, so its log is read once."""
    summary = cut(summary)
    base = (summary.filter(F.col("run").contains(marker))
                   .agg(F.max_by("final_val_ppl", "run")).first()[0])   # one value
    j = summary.withColumn("_base", F.lit(base).cast("double"))
    imp = F.when(is_finite("_base"),
                 (F.col("_base") - F.col("final_val_ppl")) / F.col("_base") * F.lit(100.0))
    return j.withColumn("ppl_improve_vs_base_pct", imp).drop("_base")


def grid_cells(log: DataFrame, experts: int = 8) -> DataFrame:
    """Sweep grid cells (G10, G22, B7, B8): runs named
    [all_]moe_e<E>_rj<RJ>_cf<CF>_s<S> with E = ``experts``; best ppl and
    step by the not-missing rule (G4). Runs without rows are absent; a log
    with a header only has a cell of (NaN, -1) if the reader keeps it."""
    return cells_of(run_facts(log), experts)


def cells_of(facts: DataFrame, experts: int = 8) -> DataFrame:
    """:func:`grid_cells` from :func:`run_facts`."""
    p = F.col("_p")
    d = facts.filter("rows > 0").withColumn("_p", parse_run_name("run")).filter(p["matched"] & (p["experts"] == experts))
    return d.select("run", p["rj"].alias("rj"), p["cf"].alias("cf"), F.coalesce("kept.v", F.lit(NAN)).alias("best_ppl"),
                    F.coalesce("kept.s", F.lit(-1)).cast("long").alias("best_step"))


def cf_column(cf: float) -> str:
    return "cf_" + repr(float(cf)).replace(".", "_")


def cf_values(cells: DataFrame) -> list:
    """The grid's CF axis, ascending (pivot values; one per column)."""
    return sorted(r[0] for r in cells.select("cf").distinct().collect())


def grid_pivot(cells: DataFrame, values: list | None = None) -> DataFrame:
    """RJ x CF table of best ppl, both axes ascending (G11). Two runs in one
    cell fail the job (pivoting would merge them silently). ``values`` is
    the CF axis when the caller already has it (see :func:`cf_values`)."""
    one = (cells.groupBy("rj", "cf")
                .agg(F.count(F.lit(1)).alias("_n"), F.first("best_ppl").alias("best_ppl"))
                .withColumn("best_ppl", F.when(F.col("_n") > 1, F.raise_error(F.concat(
                    F.lit("duplicate grid cell rj="), F.col("rj").cast("string"),
                    F.lit(" cf="), F.col("cf").cast("string")))).otherwise(F.col("best_ppl"))))
    if values is None:
        values = cf_values(cells)
    p = one.groupBy("rj").pivot("cf", values).agg(F.first("best_ppl"))
    return p.select("rj", *[F.col(f"`{c}`").alias(cf_column(c)) for c in p.columns[1:]]
                    ).orderBy("rj")


def grid_labels(cells: DataFrame) -> DataFrame:
    """Heat-map labels (G13): long form of the grid, finite cells only,
    two decimals."""
    return (cells.filter(is_finite("best_ppl"))
                 .select("rj", "cf", F.format_string("%.2f", F.col("best_ppl")).alias("label")))


def curves(log: DataFrame, prefix: str | None = None, every: int | None = None) -> DataFrame:
    """Validation curves (G12, B9, B21): (run, step, val_ppl) with NaN
    dropped and inf kept; optional run-name prefix and every-k-th-step
    report filter; ordered by run then step."""
    c = log
    if prefix:
        c = c.filter(F.col("run").startswith(prefix))
    if every:
        c = c.filter(every_k("step", every))
    return c.filter(not_missing("val_ppl")).select("run", "step", "val_ppl").orderBy("run", "step")


# ---------------------------------------------------------------- sweep
# The study's sweep.
SWEEP_EXPERTS = (4, 8, 16)
SWEEP_RJ = ("0.0", "0.01", "0.05")
SWEEP_CF = ("1.0", "1.25", "1.5")


def sweep_rows(steps: int = 10000, quick: bool = False) -> list[tuple]:
    """The runs of :func:`sweep` in launch order."""
    if quick:
        steps, experts, rjs, cfs = 1500, (8,), ("0.0",), ("1.5",)
    else:
        experts, rjs, cfs = SWEEP_EXPERTS, SWEEP_RJ, SWEEP_CF
    rows = [(f"baseline_s{steps}", "baseline", 0, None, None, steps, True, False)]
    rows += [(f"all_moe_e{e}_s{steps}", "experts", e, None, None, steps, False, True)
             for e in experts]
    rows += [(f"all_moe_e8_rj{rj}_cf{cf}_s{steps}", "grid", 8, float(rj), float(cf), steps,
              False, True) for rj in rjs for cf in cfs]
    return [(i,) + r for i, r in enumerate(rows)]


def sweep(spark: SparkSession, steps: int = 10000, quick: bool = False) -> DataFrame:
    """The study's run table (G20): baseline, all-layer MoE for each expert
    count, and the RJ x CF grid at E = 8 (13 runs); quick mode has 3 runs
    (E = 8, RJ 0.0, CF 1.5, 1500 steps)."""
    schema = ("launch int, run string, kind string, moe_num_experts int, "
              "moe_router_jitter double, moe_capacity_factor double, steps int, no_moe boolean, "
              "moe_all_layers boolean")
    return spark.createDataFrame(sweep_rows(steps, quick), schema)


SETTABLE = [k for k in CONFIG_DEFAULTS if k not in ("vocab_name", "log_csv")]


def config_defaults(df: DataFrame) -> DataFrame:
    """Fill the 33 config fields with their defaults where absent or NULL."""
    out = df
    for f in CONFIG_SCHEMA.fields:
        d = F.lit(CONFIG_DEFAULTS[f.name]).cast(f.dataType)
        out = out.withColumn(f.name, F.coalesce(F.col(f.name).cast(f.dataType), d)
                             if f.name in df.columns else d)
    return out


def apply_overrides(df: DataFrame, overrides: dict) -> DataFrame:
    """Set config fields from a dict (B18); only the 31 settable fields."""
    bad = [k for k in overrides if k not in SETTABLE]
    if bad:
        raise ValueError(f"not settable: {bad}")
    types = {f.name: f.dataType for f in CONFIG_SCHEMA.fields}
    return df.withColumns({k: F.lit(v).cast(types[k]) for k, v in overrides.items()})


def normalize_configs(df: DataFrame) -> DataFrame:
    """Effective model layout per config (B17):
    no MoE when ``no_moe`` or 0 experts; MoE layers: all > explicit comma
    list (blanks skipped, de-duplicated; a list with no entries means no
    layer) > single index > none, kept only below ``n_layer``; ``d_ff``
    missing or 0 -> 4 * d_model."""
    off = F.coalesce(F.col("no_moe"), F.lit(False)) | (F.coalesce(F.col("moe_num_experts"),
                                                                  F.lit(0)) == 0)
    items = F.filter(F.transform(F.split(F.coalesce(F.col("moe_layers"), F.lit("")), ","),
                                 lambda s: F.trim(s)), lambda s: s != "")
    parsed = F.transform(items, lambda s: F.coalesce(s.try_cast("int"), F.raise_error(
        F.concat(F.lit("bad layer index: "), s)).cast("int")))
    n_layer = F.col("n_layer")
    all_l = F.sequence(F.lit(0), n_layer - 1)
    listed = F.when(F.coalesce(F.col("moe_layers"), F.lit("")) != "", parsed)
    single = F.when(F.col("moe_layer_index").isNotNull(), F.array(F.col("moe_layer_index")))
    empty = F.array().cast("array<int>")
    chosen = (F.when(F.coalesce(F.col("moe_all_layers"), F.lit(False)), all_l)
               .when(listed.isNotNull(), listed)
               .when(single.isNotNull(), single)
               .otherwise(empty))
    layers = F.array_sort(F.array_distinct(F.filter(chosen, lambda i: (i >= 0) & (i < n_layer))))
    layers = F.when(off, empty).otherwise(layers)
    d_ff = F.coalesce(F.when(F.col("d_ff") != 0, F.col("d_ff")), F.col("d_model") * 4)
    return df.select("*", (~off).alias("moe_enabled"),
                     F.when(off, F.lit(0)).otherwise(F.col("moe_num_experts")).alias("n_experts"),
                     layers.alias("moe_layer_list"), d_ff.alias("d_ff_eff"))


def join_run_meta(configs: DataFrame, summary: DataFrame,
                  best_steps: DataFrame | None = None) -> DataFrame:
    """Config, log summary and saved best step by run (D6)."""
    j = configs.join(summary, "run", "full")
    if best_steps is not None:
        j = j.join(best_steps.withColumnRenamed("best_step", "saved_best_step"), "run", "left")
    return j
