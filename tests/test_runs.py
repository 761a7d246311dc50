"""Run-directory edge cases through the whole re-summarise pipeline, with
expected frames written here."""

import math
import os

import pytest
from pyspark.sql import functions as F

from blockwise.sources import runs as S
from blockwise.sources.study import summarize_root

HEADER = "step,train_loss,aux,val_loss,val_ppl,tokens_per_sec,gpu_mem_mb\n"


def log(root, run, rows, header=True):
    os.makedirs(os.path.join(root, run), exist_ok=True)
    with open(os.path.join(root, run, "metrics.csv"), "w") as f:
        if header:
            f.write(HEADER)
        for r in rows:
            f.write(",".join(str(x) for x in r) + "\n")


def study(root):
    nan, inf = "nan", "inf"
    log(root, "baseline_a_s100", [(1, 3.0, 0.0, nan, nan, 10.0, 0.0),
                                  (2, 2.9, 0.0, 2.0, 7.4, 20.0, 0.0)])
    log(root, "baseline_b_s100", [(1, 3.0, 0.0, 2.3, 10.0, 15.0, 1.5),
                                  (2, 2.5, 0.0, 2.3, 10.0, 25.0, 2.5),
                                  (3, 2.4, 0.0, inf, inf, 30.0, nan)])
    log(root, "all_moe_e8_rj0.0_cf1.0_s100", [(1, 3.0, 1.0, 1.6, 5.0, 5.0, 1.0),
                                              (2, 2.0, 1.0, 1.4, 4.0, nan, 2.0),
                                              (3, 1.9, 1.0, 1.4, 4.0, 7.0, 3.0),
                                              (4, 1.8, 1.0, 1.5, 4.5, 6.0, 2.0)])
    log(root, "all_moe_e8_rj0.0_cf1.5_s100", [(1, 3.0, 1.0, inf, inf, 5.0, 1.0),
                                              (2, 2.0, 1.0, inf, inf, 6.0, 1.0)])
    log(root, "all_moe_e8_rj0.01_cf1.0_s100", [(1, 3.0, 1.0, nan, nan, 5.0, 1.0)])
    log(root, "moe_e4_rj0.0_cf1.0_s100", [(1, 3.0, 1.0, 1.0, 2.7, 5.0, 1.0)])
    log(root, "all_moe_e8_s100", [(1, 3.0, 1.0, 1.0, 2.7, 5.0, 1.0)])
    log(root, "header_only", [])
    log(root, "bad_number", [(1, "abc", 0.0, 1.0, "x1", 5.0, 1.0),
                             (2, 2.0, 0.0, 1.0, 3.0, "zz", 1.0)])
    os.makedirs(os.path.join(root, "no_log"))
    os.makedirs(os.path.join(root, "zero_byte"))
    open(os.path.join(root, "zero_byte", "metrics.csv"), "w").close()


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b
    return a == b


def test_summary_edges(spark, tmpdir_path):
    study(tmpdir_path)
    out = summarize_root(spark, tmpdir_path)
    got = {r.run: r for r in out["summary"].collect()}
    nan, inf = float("nan"), float("inf")
    want = {  # final, best, best_step, last_train_loss, max_tok_s, peak_mem
        "baseline_a_s100": (7.4, 7.4, 2.0, 2.9, 20.0, 0.0),
        "baseline_b_s100": (10.0, 10.0, 1.0, 2.4, 30.0, 2.5),
        "all_moe_e8_rj0.0_cf1.0_s100": (4.5, 4.0, 2.0, 1.8, 7.0, 3.0),
        "all_moe_e8_rj0.0_cf1.5_s100": (nan, nan, nan, 2.0, 6.0, 1.0),
        "all_moe_e8_rj0.01_cf1.0_s100": (nan, nan, nan, 3.0, 5.0, 1.0),
        "header_only": (nan,) * 6,
        "no_log": (nan,) * 6,
        "zero_byte": (nan,) * 6,
        "bad_number": (3.0, 3.0, 2.0, 2.0, 5.0, 1.0),
    }
    for run, w in want.items():
        r = got[run]
        vals = (r.final_val_ppl, r.best_val_ppl, r.best_step, r.last_train_loss, r.max_tok_s,
                r.peak_mem_mb)
        assert all(same(a, b) for a, b in zip(vals, w)), (run, vals, w)
    # baseline = last name containing 'baseline' (b), its final ppl 10.0
    assert got["all_moe_e8_rj0.0_cf1.0_s100"].ppl_improve_vs_base_pct == pytest.approx(55.0)
    assert math.isnan(got["no_log"].ppl_improve_vs_base_pct)
    assert [r.run for r in out["summary"].collect()] == sorted(got)
    assert os.path.isdir(os.path.join(tmpdir_path, "summary.csv"))


def test_grid_edges(spark, tmpdir_path):
    study(tmpdir_path)
    out = summarize_root(spark, tmpdir_path)
    cells = {(r.rj, r.cf): (r.best_ppl, r.best_step) for r in out["cells"].collect()}
    assert cells[(0.0, 1.0)] == (4.0, 2)                  # tie -> first step
    assert cells[(0.0, 1.5)] == (float("inf"), 1)         # inf may win when alone
    assert math.isnan(cells[(0.01, 1.0)][0]) and cells[(0.01, 1.0)][1] == -1
    assert len(cells) == 3                                  # e4 and no-grid names left out
    g = out["grid"].collect()
    assert [r.rj for r in g] == [0.0, 0.01]
    assert g[0].cf_1_0 == 4.0 and g[0].cf_1_5 == float("inf")
    labels = {(r.rj, r.cf): r.label for r in out["labels"].collect()}
    assert labels == {(0.0, 1.0): "4.00"}
    assert os.path.isdir(os.path.join(tmpdir_path, "router_grid_e8.csv"))
    cur = out["curves"].collect()
    assert all(not math.isnan(r.val_ppl) for r in cur)
    assert any(r.val_ppl == float("inf") for r in cur)


def test_header_only_log_has_a_cell(spark, tmpdir_path):
    study(tmpdir_path)
    log(tmpdir_path, "moe_e8_rj0.05_cf1.25_s100", [])                           # a log without rows, older name
    os.makedirs(os.path.join(tmpdir_path, "all_moe_e8_rj0.05_cf1.5_s100"))      # no log
    out = summarize_root(spark, tmpdir_path)
    cells = {(r.rj, r.cf): (r.best_ppl, r.best_step) for r in out["cells"].collect()}
    assert math.isnan(cells[(0.05, 1.25)][0]) and cells[(0.05, 1.25)][1] == -1 and len(cells) == 4
    got = {r.run: r.final_val_ppl for r in out["summary"].collect()}
    assert math.isnan(got["moe_e8_rj0.05_cf1.25_s100"]) and math.isnan(got["all_moe_e8_rj0.05_cf1.5_s100"])
    assert [r.cf_1_25 for r in out["grid"].orderBy("rj").collect()][:2] == [None, None]
    assert S.read_runs(spark, tmpdir_path).filter("run = 'moe_e8_rj0.05_cf1.25_s100'").count() == 0


def test_duplicate_cell_fails(spark, tmpdir_path):
    log(tmpdir_path, "all_moe_e8_rj0.0_cf1.0_s100", [(1, 3.0, 1.0, 1.6, 5.0, 5.0, 1.0)])
    log(tmpdir_path, "all_moe_e8_rj0.0_cf1.0_s200", [(1, 3.0, 1.0, 1.6, 6.0, 5.0, 1.0)])
    from blockwise.operators.runs import grid_cells, grid_pivot
    with pytest.raises(Exception, match="duplicate grid cell"):
        grid_pivot(grid_cells(S.read_runs(spark, tmpdir_path))).collect()


def test_metrics_round_trip(spark, tmpdir_path):
    study(tmpdir_path)
    logs = S.read_runs(spark, tmpdir_path).filter("run like 'all_moe_e8_rj0.0_cf1.%'")
    out = os.path.join(tmpdir_path, "rewritten")
    S.write_metrics(logs, out)
    back = S.read_runs(spark, out)
    a = sorted(tuple(r) for r in logs.collect())
    b = sorted(tuple(r) for r in back.collect())
    assert len(a) == len(b) and all(all(same(x, y) for x, y in zip(p, q)) for p, q in zip(a, b))
    text = open([os.path.join(dp, f) for dp, _, fs in os.walk(out) for f in fs
                 if f.endswith(".csv") and "cf1.5" in dp][0]).read()
    assert text.splitlines()[0] == HEADER.strip()
    assert "inf" in text and "2.000000" in text


def test_configs_and_meta(spark, tmpdir_path):
    import json
    from blockwise.operators import runs as R
    for run, cfg in {"a": {"moe_layers": "1, 3,,3", "n_layer": 4, "d_ff": 0},
                     "b": {"no_moe": True}, "c": {"moe_all_layers": True, "n_layer": 2},
                     "d": {"moe_layers": ",", "moe_layer_index": 1}}.items():
        os.makedirs(os.path.join(tmpdir_path, run))
        full = dict(S.CONFIG_DEFAULTS, **cfg)
        json.dump(full, open(os.path.join(tmpdir_path, run, "config.json"), "w"), indent=2)
        open(os.path.join(tmpdir_path, run, "best_step.txt"), "w").write("200")
    c = R.normalize_configs(S.read_run_configs(spark, tmpdir_path))
    got = {r.run: (r.moe_enabled, r.n_experts, r.moe_layer_list, r.d_ff_eff) for r in c.collect()}
    assert got["a"] == (True, 8, [1, 3], 2048)
    assert got["b"] == (False, 0, [], 2048)
    assert got["c"] == (True, 8, [0, 1], 2048)
    assert got["d"] == (True, 8, [], 2048)          # a list with no entries wins over the index
    meta = S.meta_json(S.read_run_configs(spark, tmpdir_path).withColumn("step", R.F.lit(7)))
    doc = json.loads(meta.filter("run = 'a'").collect()[0].json)
    assert doc["arch"]["moe_layers"] == "1, 3,,3" and doc["step"] == 7
    assert {r.run: r.best_step for r in S.read_best_steps(spark, tmpdir_path).collect()}["a"] == 200
    with pytest.raises(ValueError):
        R.apply_overrides(c, {"log_csv": False})


def test_resummarise_is_idempotent_and_joins_meta(spark, tmpdir_path):
    from blockwise.operators import runs as R
    study(tmpdir_path)
    first = {r.run for r in summarize_root(spark, tmpdir_path)["summary"].collect()}
    second = {r.run for r in summarize_root(spark, tmpdir_path)["summary"].collect()}
    assert first == second and "summary.csv" not in second        # report folders are not runs
    cfg = spark.createDataFrame([("baseline_b_s100", 4), ("ghost", 2)], "run string, n_layer int")
    best = spark.createDataFrame([("baseline_b_s100", 1)], "run string, best_step long")
    j = {r.run: r for r in R.join_run_meta(cfg, summarize_root(spark, tmpdir_path, write=False)
                                           ["summary"], best).collect()}
    assert j["baseline_b_s100"].saved_best_step == 1 and j["baseline_b_s100"].n_layer == 4
    assert j["ghost"].final_val_ppl is None and j["no_log"].n_layer is None


def test_eval_points(spark):
    from blockwise.operators.runs import eval_points
    df = spark.range(1, 41).withColumnRenamed("id", "step")
    assert [r.step for r in eval_points(df, 20).collect()] == [20, 40]
    assert eval_points(df, 0).count() == 0


def test_hot_run_log_is_written_by_many_tasks(spark, tmpdir_path):
    from pyspark.sql import functions as F
    n = 3 * 4096 + 5                       # three step buckets and a bit
    log = spark.range(1, n + 1).select(
        F.lit("hot").alias("run"), F.col("id").alias("step"),
        (F.col("id") / 1000.0).alias("train_loss"), F.lit(0.0).alias("aux"),
        F.lit(1.0).alias("val_loss"), F.lit(2.0).alias("val_ppl"),
        F.lit(10.0).alias("tokens_per_sec"), F.lit(1.0).alias("gpu_mem_mb"))
    out = os.path.join(tmpdir_path, "logs")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")           # tiny data: AQE would merge every task
    try:
        S.write_metrics(log, out)
    finally:
        spark.conf.set(key, before)
    files = [f for f in os.listdir(os.path.join(out, "run=hot")) if f.endswith(".csv")]
    assert len(files) > 1                  # not one task for the whole run
    back = S.read_runs(spark, out)
    assert back.count() == n and back.select(F.countDistinct("step")).first()[0] == n
    assert {r.run for r in back.select("run").distinct().collect()} == {"hot"}


def test_vs_baseline_without_usable_baseline(spark):
    from blockwise.operators.runs import vs_baseline
    schema = "run string, final_val_ppl double"
    none = vs_baseline(spark.createDataFrame([("a", 10.0), ("b", 5.0)], schema))
    assert [r.ppl_improve_vs_base_pct for r in none.collect()] == [None, None]
    inf = vs_baseline(spark.createDataFrame([("baseline_x", float("inf")), ("b", 5.0)], schema))
    assert {r.run: r.ppl_improve_vs_base_pct for r in inf.collect()} == {"baseline_x": None,
                                                                       "b": None}
    last = vs_baseline(spark.createDataFrame(
        [("baseline_a", 10.0), ("baseline_b", 20.0), ("m", 5.0)], schema))   # last by name
    assert {r.run: r.ppl_improve_vs_base_pct for r in last.collect()}["m"] == 75.0


def test_logs_with_other_headers(spark, tmpdir_path):
    for run, lines in {"new": ["step,train_loss,aux,val_loss,val_ppl,tokens_per_sec,gpu_mem_mb", "1,2.0,0.1,3.0,20.0,7.5,9.0"],
                       "old": ["val_ppl,note,step", "15.5,x,2", "", "nan,y,3"],
                       "bare": ["step,train_loss", "4,1.5"]}.items():
        os.makedirs(f"{tmpdir_path}/{run}")
        with open(f"{tmpdir_path}/{run}/metrics.csv", "w") as f:
            f.write("\r\n".join(lines) + "\r\n")
    from blockwise.operators.runs import curves
    from blockwise.sources.runs import read_runs
    logs = read_runs(spark, tmpdir_path)
    got = {(r["run"], r["step"]): (r["train_loss"], r["val_ppl"], r["gpu_mem_mb"]) for r in logs.collect()}
    assert set(got) == {("new", 1), ("old", 2), ("old", 3), ("bare", 4)}
    assert got[("new", 1)] == (2.0, 20.0, 9.0)
    assert got[("old", 2)][1] == 15.5 and all(math.isnan(got[("old", 2)][k]) for k in (0, 2))
    assert got[("bare", 4)][0] == 1.5 and math.isnan(got[("bare", 4)][1])
    assert [tuple(r) for r in curves(logs).collect()] == [("new", 1, 20.0), ("old", 2, 15.5)]


def test_metadata_sinks_read_back(spark, tmpdir_path):
    from blockwise.operators.runs import config_defaults
    from blockwise.sources import runs as S
    cfg = config_defaults(spark.createDataFrame([("a", 7, 100), ("b c:1+%", None, 200)], "run string, seed int, step long"))
    S.write_run_configs(cfg, f"{tmpdir_path}/configs")
    S.write_run_meta(cfg, f"{tmpdir_path}/meta")
    S.write_best_steps(cfg.select("run", F.col("step").alias("best_step")), f"{tmpdir_path}/best")
    names = ["run", *S.CONFIG_DEFAULTS]
    back = {r["run"]: r for r in S.read_run_configs(spark, f"{tmpdir_path}/configs").select(*names).collect()}
    assert back == {r["run"]: r for r in cfg.select(*names).collect()}
    meta = {r["run"]: (r["enc_name"], r["arch"]["d_model"], r["step"]) for r in S.read_run_meta(spark, f"{tmpdir_path}/meta").collect()}
    assert meta == {"a": ("gpt2", 512, 100), "b c:1+%": ("gpt2", 512, 200)}
    assert {tuple(r) for r in S.read_best_steps(spark, f"{tmpdir_path}/best").collect()} == {("a", 100), ("b c:1+%", 200)}


def test_smoothed_probabilities_sum_to_one(spark):
    from blockwise.operators.scoring import fit_bigrams, score_heldout
    train = spark.createDataFrame([(1, "a b a c b".split()), (2, "c a".split())], "doc_id long, toks array<string>")
    words = "abcd"          # d follows nothing in training
    held = spark.createDataFrame([(i * 10 + j, [x, y]) for i, x in enumerate(words) for j, y in enumerate(words)],
                                 "doc_id long, toks array<string>")
    got = score_heldout(held, fit_bigrams(train), 0.5, n_vocab=len(words)).collect()
    for x in words:
        assert abs(sum(math.exp(-r["nll"]) for r in got if r["tok"] == x) - 1) < 1e-9


def test_report_files_hold_the_reports(spark, tmpdir_path):
    """summary.csv and the grid file read back equal what was written, in order, null cells empty."""
    import csv
    import glob

    from blockwise.sources import runs as Rn
    rows = [("b_s1", 2.5, 10), ("a_s1", float("nan"), None), ("c,\"q\"", float("inf"), 3)]
    df = spark.createDataFrame(rows, "run string, best_val_ppl double, best_step long")
    pivot = spark.createDataFrame([(0.2, 1.0, None), (0.0, 3.5, 4.25)], "rj double, cf_1_0 double, cf_1_25 double")

    def read(folder):
        [part] = glob.glob(f"{folder}/part-*.csv")
        return list(csv.reader(open(part), escapechar="\\"))

    got = read(Rn.write_summary(df, tmpdir_path))
    assert got[0] == df.columns and [r[0] for r in got[1:]] == ["a_s1", "b_s1", "c,\"q\""]
    assert [r[1] for r in got[1:]] == ["NaN", "2.5", "Infinity"] and [r[2] for r in got[1:]] == ["", "10", "3"]
    grid = read(Rn.write_grid(pivot, tmpdir_path, 8))
    assert grid == [["rj", "cf_1_0", "cf_1_25"], ["0.0", "3.5", "4.25"], ["0.2", "1.0", ""]]


def test_packing_refuses_a_typed_marker(spark, tmpdir_path):
    import pytest

    from blockwise.plans import queries as Q
    d = spark.createDataFrame([(0, "a b", "en", "s"), (1, "a <eos> b", "en", "s")], "doc_id long, text string, lang string, source string")
    d.write.parquet(f"{tmpdir_path}/documents.parquet")
    with pytest.raises(Exception, match="end-of-text marker"):
        Q.QUERIES["packed_blocks"](spark, tmpdir_path).collect()


def test_a_log_line_is_split_once_and_run_names_are_read_once_a_file(spark, tmpdir_path):
    """Run names and headers cost a row per file, not per line; a data line
    may hold a column's name inside a cell, a header may be quoted or repeated."""
    import os

    from blockwise.sources.runs import read_runs
    logs = {"run=a+b%20c/part-0.csv": 'step,"val_ppl"\n1,2.5\nstep9,3.5\n', "d/metrics.csv": "val_ppl, step \r\n4.5,2\r\n\r\nval_ppl, step \r\n",
            "e/metrics.csv": "step,train_loss\n", "f/metrics.csv": "step,aux\n7\n"}
    for name, text in logs.items():
        os.makedirs(os.path.dirname(f"{tmpdir_path}/{name}"))
        open(f"{tmpdir_path}/{name}", "w").write(text)
    df = read_runs(spark, tmpdir_path, keep_empty=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "url_decode" not in plan and plan.count("split(line") <= 1
    got = sorted((r.run, r.step, str(r.val_ppl)) for r in df.filter("step is not null").collect())
    assert got == [("a+b c", 1, "2.5"), ("d", 2, "4.5"), ("f", 7, "nan")]
    assert sorted((r.run, str(r.val_ppl)) for r in df.filter("step is null").collect()) == [("a+b c", "3.5"), ("e", "nan")]


def test_heldout_scores_reuse_the_counting_of_the_bigrams(spark):
    """The model is looked up where it was counted; pairs come once for each
    time they stand in a text, and an unseen pair has its token's count."""
    import math

    from blockwise.operators.scoring import fit_bigrams, score_heldout
    train = spark.createDataFrame([(1, ["a", "b", "a", "b", "c"])], "doc_id long, toks array<string>")
    held = spark.createDataFrame([(2, ["a", "b", "a", "b"]), (3, ["a", "c"]), (3, ["z", "a"]), (4, ["a"])], "doc_id long, toks array<string>")
    df = score_heldout(held, fit_bigrams(train), 1.0, n_vocab=3)
    p = {("a", "b"): 3 / 5, ("b", "a"): 2 / 5, ("a", "c"): 1 / 5, ("z", "a"): 1 / 3}
    want = [(2, "a", "b"), (2, "a", "b"), (2, "b", "a"), (3, "a", "c"), (3, "z", "a")]
    got = df.collect()
    assert sorted((r.doc_id, r.tok, r.nxt) for r in got) == want
    assert all(math.isclose(r.nll, -math.log(p[r.tok, r.nxt])) for r in got)
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
