from blockwise.operators.stopping import early_stop
from blockwise.streaming import metrics as S


def test_live_monitor_equals_batch_fold_and_ignores_late_rows(spark, tmpdir_path):
    rows = [("a", s, v) for s, v in enumerate([5.0, 4.0, 4.5, 4.4, 4.6, 4.7, 3.0, 3.5, 3.6,
                                                3.7, 3.8, 3.9], start=1)]
    rows += [("b", s, float("nan")) for s in range(1, 9)]
    df = spark.createDataFrame(rows, "run string, step long, val_ppl double")
    df.filter("step <= 5").repartition("run").write.parquet(f"{tmpdir_path}/parts/p1")
    df.filter("step > 5").repartition("run").write.mode("append").parquet(f"{tmpdir_path}/parts/p2")
    # a late duplicate of step 2 arrives last and is ignored
    spark.createDataFrame([("a", 2, 0.1)], "run string, step long, val_ppl double") \
        .write.mode("append").parquet(f"{tmpdir_path}/parts/p3")
    ev = S.stream_early_stop(S.stream_metrics(spark, f"{tmpdir_path}/parts/*", files_per_batch=1),
                             3, 0.2, 4)
    S.run_to_end(ev, f"{tmpdir_path}/out", f"{tmpdir_path}/ck")
    got = spark.read.parquet(f"{tmpdir_path}/out")
    stops = {r.run: (r.step, r.best_val, r.best_step) for r in got.filter("event = 'stop'").collect()}
    want = {r.run: (r.stop_step, r.best_val, r.best_step)
            for r in early_stop(df, 3, 0.2, 4).collect() if r.stop_step is not None}
    assert stops == want
    bests = [r.step for r in got.filter("event = 'best' and run = 'a'").orderBy("step").collect()]
    assert bests == [1, 2]            # nothing is emitted after the stop at step 5


def test_live_end_fires_the_time_stop_and_the_budget(spark, tmpdir_path):
    """The first rule to fire ends a run; a run without one has no row; chunks bound a state step."""
    import datetime as dt

    from blockwise.operators import stopping as St
    t0 = dt.datetime(2024, 1, 1)
    rows = [("slow", s, t0 + dt.timedelta(minutes=7 * s), 100.0 - s) for s in range(1, 40)]
    rows += [("long", s, t0 + dt.timedelta(seconds=s), 100.0 - s) for s in range(1, 80)]
    rows += [("flat", s, t0 + dt.timedelta(seconds=s), 5.0) for s in range(1, 30)]
    rows += [("short", s, t0 + dt.timedelta(seconds=s), 100.0 - s) for s in range(1, 9)]
    log = spark.createDataFrame(rows, "run string, step long, ts timestamp, val_ppl double")
    S.write_chunks(log, f"{tmpdir_path}/parts", 10)
    ends = S.stream_run_end(S.stream_metrics(spark, f"{tmpdir_path}/parts", schema=log.schema, files_per_batch=2),
                            4, 0.5, 6, 60, 4, 50)
    S.run_to_end(ends, f"{tmpdir_path}/ends", f"{tmpdir_path}/ck")
    got = {r.run: (r.step, r.reason) for r in spark.read.parquet(f"{tmpdir_path}/ends").collect()}
    assert got == {"slow": (12, "time"), "long": (50, "budget"), "flat": (6, "plateau")}
    batch = St.run_end(log, St.early_stop(log, 4, 0.5, 6), St.time_stop(log, 60, 4), 50)
    assert {r.run: r.end_step for r in batch.collect()} == {**{k: v[0] for k, v in got.items()}, "short": 8}


def test_live_log_survives_a_restart(spark, tmpdir_path):
    """Logs of two layouts streamed; the sink dies before, and after, a batch is
    written whole: nothing is lost, nothing doubled."""
    import os

    import pytest

    from blockwise.sources.runs import read_runs
    layouts = {"a": "step,val_ppl,train_loss\n1,5.5,2.0\n2,nan,1.5\n", "b": "val_ppl,step\n7.25,1\n\n6.0,2\n",
               "c": "", "d": "step,train_loss\n", "e": "step,val_ppl,extra\n1,bad,9\n"}
    for run, text in layouts.items():
        os.makedirs(f"{tmpdir_path}/logs/{run}")
        open(f"{tmpdir_path}/logs/{run}/metrics.csv", "w").write(text)
    sink = S.live_log(f"{tmpdir_path}/live")
    left = {"before": True, "after": True}

    def failing(rows, batch_id):
        for when in ("before", "after"):
            if when == "after":
                sink(rows, batch_id)
            if batch_id == 1 and left.pop(when, False):
                raise RuntimeError("lost driver")

    for _ in range(2):
        with pytest.raises(Exception, match="lost driver"):
            S.ingest_logs(S.stream_log_lines(spark, f"{tmpdir_path}/logs", files_per_batch=2), failing, f"{tmpdir_path}/ck")
    S.ingest_logs(S.stream_log_lines(spark, f"{tmpdir_path}/logs", files_per_batch=2), failing, f"{tmpdir_path}/ck")
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    want = read_runs(spark, f"{tmpdir_path}/logs").collect()
    assert key(read_runs(spark, f"{tmpdir_path}/live", S.LIVE_GLOB).collect()) == key(want) and len(want) == 5


def test_rows_of_a_state_step_come_in_the_order_of_steps():
    """As a stable sort of the joined frames gives them, without joining them."""
    import pandas as pd
    frames = [pd.DataFrame({"step": [3, 1], "val_ppl": [5.0, float("nan")], "ts": pd.to_datetime(["2024-01-01 00:00:01.5", "2024-01-01 00:00:00.0"])}),
              pd.DataFrame({"step": [1, 2], "val_ppl": [7.0, 8.0], "ts": pd.to_datetime(["2024-01-02 00:00:00", "1969-12-31 23:59:59"])})]
    got = S.by_step(iter(frames), "val_ppl", "ts")
    assert [(s, str(v), t) for s, v, t in got] == [
        (1, "nan", 1704067200000000), (1, "7.0", 1704153600000000), (2, "8.0", -1000000), (3, "5.0", 1704067201500000)]
    assert S.by_step(iter(frames), "val_ppl")[2] == (2, 8.0) and S.by_step(iter([]), "val_ppl") == []
