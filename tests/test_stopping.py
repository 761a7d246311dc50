"""The parallel best tracking / plateau stop against a plain ordered fold,
on random, monotone and NaN/inf-laden series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwise.operators import stopping as St

INF, NAN = float("inf"), float("nan")


def fold(vals, delta, patience, warmup):
    best, bstep, no, stop, rows = INF, -1, 0, None, []
    for s, v in vals:
        imp = v + delta < best
        if imp:
            best, bstep, no = v, s, 0
        else:
            no += 1
            if stop is None and s >= warmup and no >= patience:
                stop = s
        rows.append((s, imp, best, bstep, no))
    return rows, stop


def series(kind, n, rng):
    if kind == "random":
        return [rng.choice([rng.uniform(1, 10), rng.uniform(1, 10), INF, NAN]) for _ in range(n)]
    if kind == "decreasing":
        return [100.0 - 0.07 * i for i in range(n)]
    if kind == "plateau":
        return [5.0 + 0.01 * rng.random() for _ in range(n)]
    return [NAN] * n


@pytest.mark.parametrize("delta", [0.0, 0.1, 1.0])
def test_track_and_stop_match_fold(spark, delta):
    rng = random.Random(3)
    rows = []
    for k, kind in enumerate(["random"] * 6 + ["decreasing", "plateau", "allnan"]):
        for i, v in enumerate(series(kind, 60 + k, rng)):
            rows.append((f"r{k}", i + 1, v))
    df = spark.createDataFrame(rows, "run string, step long, val_ppl double")
    got = {(r.run, r.step): r for r in St.track_best(df, delta, fan=3).collect()}
    stops = {r.run: r for r in St.early_stop(df, 4, delta, 10).collect()}
    for run in {r[0] for r in rows}:
        vals = [(s, v) for r0, s, v in rows if r0 == run]
        want, stop = fold(vals, delta, 4, 10)
        for s, imp, best, bstep, no in want:
            g = got[(run, s)]
            assert (g.improved, g.best_val, g.best_step, g.no_improve) == (imp, best, bstep, no)
        assert stops[run].stop_step == stop
        at = [w for w in want if w[0] == (stop if stop is not None else vals[-1][0])][0]
        assert (stops[run].best_val, stops[run].best_step) == (at[2], at[3])


def test_time_stop_only_at_evaluations(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", s, t0 + dt.timedelta(minutes=7 * s), 1.0) for s in range(1, 30)]
    df = spark.createDataFrame(rows, "run string, step long, ts timestamp, val_ppl double")
    # elapsed since step 1 reaches 60 min at step 10 (63 min), but the next
    # evaluation (every 4th step) is step 12
    assert St.time_stop(df, 60, 4).collect()[0].time_stop_step == 12
    assert St.time_stop(df, None, 4).collect()[0].time_stop_step is None


def test_end_truncate_snapshot(spark):
    rows = [("a", s, float(v)) for s, v in enumerate([5, 4, 3, 3, 3, 3, 3, 3, 3, 3], start=1)]
    rows += [("b", s, 9.0) for s in range(1, 6)]
    df = spark.createDataFrame(rows, "run string, step long, val_ppl double")
    stops = St.early_stop(df, 3, 0.0, 2)
    times = St.time_stop(df, None, 1)
    ends = {r.run: r.end_step for r in St.run_end(df, stops, times, 8).collect()}
    assert ends == {"a": 6, "b": 4}
    kept = St.truncate_runs(df, St.run_end(df, stops, times, 8))
    assert kept.filter("run = 'a'").count() == 6
    snap = {r.run: r for r in St.pick_snapshot(St.track_best(df), St.run_end(df, stops, times, 8),
                                               save_every=2).collect()}
    assert (snap["a"].best_step, snap["a"].snapshot_step, snap["a"].meta_step) == (3, 3, 6)
    assert snap["a"].n_saves == 3
    assert (snap["b"].best_step, snap["b"].snapshot_step) == (1, 1)


@pytest.mark.parametrize("delta", [0.0, 0.1, 1.0, 1000.0])
def test_composed_maps_match_fold(spark, delta):
    """Runs over many ranges, maps composed two at a time, a null run."""
    rng = random.Random(11)
    rows = []
    for k, kind in enumerate(["random", "decreasing", "plateau", "random", "allnan"]):
        vals = series(kind, 400 + 7 * k, rng)
        if kind == "decreasing":
            vals = [v - 0.3 * math.floor(i / 5) for i, v in enumerate(vals)]
        rows += [(f"r{k}" if k else None, 3 * i + 1, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "run string, step long, val_ppl double").withColumn("improved", F.lit("x"))
    got = {(r.run, r.step): r for r in St.track_best(df, delta, fan=2).collect()}
    assert len(got) == len(rows)
    for run in {r[0] for r in rows}:
        want, _ = fold([(s, v) for r0, s, v in rows if r0 == run], delta, 4, 10)
        for n, (s, imp, best, bstep, no) in enumerate(want):
            g = got[(run, s)]
            assert (g.improved, g.best_val, g.best_step, g.no_improve, g.eval_idx) == (imp, best, bstep, no, n)
    assert St.track_best(df.limit(0), delta).count() == 0
    with pytest.raises(ValueError):
        St.track_best(df, -0.1)


@pytest.mark.parametrize("delta", [0.0, 0.0035, 5000.0])
def test_million_decreasing_rows(spark, delta):
    """Every row of one strictly decreasing run is a candidate."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("r").alias("run"), "id", F.col("id").alias("step"),
                               (F.lit(2000.0) - F.col("id") * 0.001).alias("val_ppl"))
    got = St.track_best(df, delta, fan=2).groupBy("improved").agg(
        F.count("step").alias("n"), F.sum("step").alias("s"), F.sum("best_step").alias("b"), F.sum("no_improve").alias("no"))
    best, at, counts = INF, -1, {}
    for i in range(n):
        v = 2000.0 - i * 0.001
        imp = v + delta < best
        if imp:
            best, at = v, i
        c = counts.setdefault(imp, [0, 0, 0, 0])
        c[0] += 1
        c[1] += i
        c[2] += at
        c[3] += i - at
    assert {r.improved: [r.n, r.s, r.b, r.no] for r in got.collect()} == counts


def test_stretch_maps_compose():
    """The map of two stretches is the composition of theirs, at every incoming best."""
    rng = random.Random(5)
    for _ in range(200):
        vals = np.array([rng.choice([rng.randint(0, 30), rng.randint(0, 30), NAN, INF]) for _ in range(rng.randint(0, 14))], float)
        delta, cut, n = rng.choice([0, 1, 2.5, 40]), rng.randint(0, len(vals)), np.arange(len(vals))
        whole = St.stretch_map(vals, n, n, delta)
        both = St.stretch_map(vals[:cut], n[:cut], n[:cut], delta).then(St.stretch_map(vals[cut:], n[cut:], n[cut:], delta))
        for b in [INF, *range(-3, 74)]:
            state = (float(b), -1, -1)
            for i, v in enumerate(vals):
                if v + delta < state[0]:
                    state = (float(v), i, i)
            assert whole.apply((float(b), -1, -1)) == state == both.apply((float(b), -1, -1))


def test_runs_within_one_range_are_not_composed(spark, monkeypatch):
    """The composed maps follow the ranges, not the runs; a null run is a run."""
    rng, seen, whole = random.Random(7), [], St._incoming
    monkeypatch.setattr(St, "_incoming", lambda maps, *a: seen.append(maps.count()) or whole(maps, *a))
    runs = {None if k == 9 else f"r{k:03d}": [(i + 1, float(rng.randint(0, 50))) for i in range(6)] for k in range(400)}
    df = spark.createDataFrame([(r, s, v) for r, vals in runs.items() for s, v in vals], "run string, step long, val_ppl double")
    got = {(r.run, r.step): (r.improved, r.best_val, r.best_step, r.eval_idx, r.no_improve) for r in St.track_best(df, 1.0).collect()}
    assert seen[0] <= 2 * St.n_ranges(df) and len(got) == 2400
    for run, vals in runs.items():
        best, at, no = INF, -1, 0
        for i, (s, v) in enumerate(vals):
            better = v + 1.0 < best
            best, at, no = (v, s, 0) if better else (best, at, no + 1)
            assert got[run, s] == (better, best, at, i, no)
