"""Best tracking with hysteresis, plateau and time stops, run truncation
and snapshot choice (G14-G19).

The training loop's decision is an ordered fold per run: accept an
evaluation when ``ppl + min_delta < best`` (best starts at +inf), else
count a non-improvement; stop once ``step >= warmup`` and the count
reaches ``patience``. It is computed without folding whole runs. What a stretch of a run does to
the best value is a map from the incoming best to the outgoing one: with
w_i = v_i + min_delta, the incoming best meets the first candidate (strict
prefix minimum of the stretch; nothing else can be accepted) whose w_i lies
below it, and the chain of acceptances from there on is fixed. The map is a
falling list of breakpoints with the state that each leads to, equal states
merged, and two maps compose into one.

* :func:`stretch_map` makes the map of each (run, range) of the log, which is
  dealt into sampled ranges of (run, step), so a run with any share of the
  rows is many ranges;
* the maps of the runs that reach more than one range, two a range at most,
  are composed ``fan`` at a time, level by level, and the incoming state of
  their ranges comes down the same levels; other runs start from no best;
* one more pass over the ranges writes the state after every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from blockwise.functions.numeric import INF
from blockwise.operators.prefix import _R, FAN, SUM, carried, n_ranges, ranged
from blockwise.session import cut

MAP_FAN = 16            # maps composed in one task
_MAP = "run {run}, _rng int, w array<double>, v array<double>, step array<long>, idx array<long>"
_STATE = "run {run}, _rng int, v double, step long, idx long"
_NONE = (INF, -1, -1)   # value, step and evaluation index of no best


class StretchMap:
    """Incoming best -> outgoing (value, step, index). ``w`` falls; an incoming
    best b leads to the state at the number of w that are >= b, and stays
    itself where there is none."""

    def __init__(self, w, v, step, idx):
        self.w, self.v, self.step, self.idx = (np.asarray(w, float), np.asarray(v, float), np.asarray(step, np.int64),
                                               np.asarray(idx, np.int64))

    def merged(self) -> StretchMap:
        """Equal neighbouring states as one."""
        last = np.append(self.idx[1:] != self.idx[:-1], True) if len(self.idx) else np.zeros(0, bool)
        return StretchMap(self.w[last], self.v[last], self.step[last], self.idx[last])

    def at(self, best):
        """Place of each incoming best."""
        return np.searchsorted(-self.w, -np.asarray(best, float), side="right")

    def apply(self, state):
        k = int(self.at(state[0]))
        return state if k == len(self.w) else (float(self.v[k]), int(self.step[k]), int(self.idx[k]))

    def then(self, later: StretchMap) -> StretchMap:
        """This map followed by a later stretch's."""
        k = later.at(self.v)
        moved = k < len(later.w)
        pick = np.minimum(k, max(0, len(later.w) - 1))
        own = [np.where(moved, b[pick], a) if len(b) else a
               for a, b in ((self.v, later.v), (self.step, later.step), (self.idx, later.idx))]
        rest = later.w < self.w[-1] if len(self.w) else np.ones(len(later.w), bool)
        return StretchMap(*[np.append(a, b[rest]) for a, b in
                            zip((self.w, *own), (later.w, later.v, later.step, later.idx))]).merged()


def candidates(value: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, w, next): the strict prefix minima of a stretch, their
    breakpoints, and for each the first later one that it gives way to."""
    v = np.where(np.isnan(value), INF, value)
    low = np.minimum.accumulate(v) if len(v) else v
    at = np.flatnonzero(v < np.append(INF, low[:-1])[:len(v)])
    w = v[at] + delta
    return at, w, np.searchsorted(-w, -v[at], side="right")


def stretch_map(value: np.ndarray, step: np.ndarray, idx: np.ndarray, delta: float) -> StretchMap:
    at, w, following = candidates(value, delta)
    own = np.arange(len(at))
    end = np.where(following < len(at), following, own)
    while len(end) and (end[end] != end).any():      # doubled steps along the chains
        end = end[end]
    last = at[end] if len(at) else at
    return StretchMap(w, value[last], step[last], idx[last]).merged()


def _stretches(table: pa.Table):
    """(run, first row, row after the last) of a table sorted by run."""
    run = table.column("run").combine_chunks().dictionary_encode()
    code = run.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    edge = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else []
    for a, b in zip(edge, np.append(edge[1:], len(code)) if len(code) else []):
        yield table.column("run")[int(a)].as_py(), int(a), int(b)


def _rows(table: pa.Table, schema: str, rows: list) -> pa.Table:
    """Python tuples as a table with the columns of ``table``'s run and a schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [table.schema.field("run").type, *[{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(),
             "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}[c.split()[1]]
             for c in schema.split(", ")[1:]]]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _maps(d: DataFrame, value: str, delta: float, kind: str) -> DataFrame:
    """The map of each (run, range); ``idx`` counts evaluations within it."""
    schema = _MAP.format(run=kind)

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("step", "ascending")])
        v = table.column("_v").to_numpy().astype(float)
        step, rng = table.column("step").to_numpy(), table.column(_R)[0].as_py() if len(table) else 0
        out = []
        for run, a, b in _stretches(table):
            m = stretch_map(v[a:b], step[a:b], np.arange(b - a), delta)
            out.append((run, rng, m.w, m.v, m.step, m.idx))
        return _rows(table, schema, out)

    v = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    return d.select("run", "step", v.alias("_v"), _R).groupBy(_R).applyInArrow(make, schema)


def _read(table: pa.Table, i: int) -> StretchMap:
    return StretchMap(*[table.column(c)[i].values.to_numpy() for c in ("w", "v", "step", "idx")])


def _incoming(maps: DataFrame, ranges: int, fan: int, kind: str) -> DataFrame:
    """(run, _rng, v, step, idx): the state that each range meets."""
    state = _STATE.format(run=kind)
    group = maps.withColumn("_up", F.floor(F.col(_R) / F.lit(fan)).cast("int"))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), (_R, "ascending")])
        out = []
        for run, a, b in _stretches(table):
            m = _read(table, a)
            for i in range(a + 1, b):
                m = m.then(_read(table, i))
            out.append((run, table.column("_up")[a].as_py(), m.w, m.v, m.step, m.idx))
        return _rows(table, _MAP.format(run=kind), out)

    def walk(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), (_R, "ascending")])
        first = {r["run"]: (r["v"], r["step"], r["idx"]) for r in above.to_pylist()}
        out = []
        for run, a, b in _stretches(table):
            now = first.get(run, _NONE)
            for i in range(a, b):
                out.append((run, table.column(_R)[i].as_py(), *now))
                now = _read(table, i).apply(now)
        return _rows(table, state, out)

    if ranges <= fan:       # one group: nothing comes from above
        above = maps.sparkSession.createDataFrame([], state)
    else:
        above = _incoming(cut(group.groupBy("_up").applyInArrow(fold, _MAP.format(run=kind))), -(-ranges // fan), fan, kind)
    above = above.withColumnRenamed(_R, "_up")
    return cut(group.groupBy("_up").cogroup(above.groupBy("_up")).applyInArrow(walk, state))


def track_best(evals: DataFrame, min_delta: float = 0.0, value: str = "val_ppl", fan: int = MAP_FAN) -> DataFrame:
    """Per evaluation row: ``improved``, ``best_val`` (+inf before any),
    ``best_step`` (-1 before any), ``eval_idx`` (0-based) and ``no_improve``
    after the row (G14). ``evals`` holds only evaluation rows (run, step,
    value, ...), a step of a run once. NaN, null and inf never improve. A
    task holds one range of the log, or ``fan`` ranges' maps of the runs that
    reach several; a map has at most as many breakpoints as the range has
    candidates with different outcomes."""
    if min_delta < 0:
        raise ValueError("min_delta is at least 0")
    delta, kind = float(min_delta), dict(evals.dtypes)["run"]
    d = ranged(evals, ["run", "step"])
    n = d.groupBy("run", _R).agg(F.count(F.lit(1)).alias("n"))
    before = carried(n, ["run"], {"n": SUM}, n_ranges(evals), FAN)
    # evaluation indexes within a range become indexes of the run
    maps = _maps(d, value, delta, kind)
    offset = before.select(F.col("run").alias("_k"), F.col(_R).alias("_kr"), F.coalesce("n", F.lit(0)).alias("off"))
    here = F.col("run").eqNullSafe(F.col("_k")) & (F.col(_R) == F.col("_kr"))
    maps = cut(maps.join(offset, here).select(
        "run", _R, "w", "v", "step", F.transform("idx", lambda i: i + F.col("off")).alias("idx"), "off"))
    # a range shares at most its first and its last run with others: only their maps meet
    shared = n.groupBy(F.col("run").alias("_k")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    meet = maps.drop("off").join(shared, F.col("run").eqNullSafe(F.col("_k")), "left_semi")
    states = _incoming(meet, n_ranges(evals), fan, kind)
    none = dict(zip(("v", "step", "idx"), map(F.lit, _NONE)))
    states = maps.select(F.col("run").alias("_k"), F.col(_R).alias("_kr"), "off").join(states, here, "left").select(
        F.col("_k").alias("run"), F.col("_kr").alias(_R), *[F.coalesce(c, x).alias(c) for c, x in none.items()], "off")
    added = T._parse_datatype_string("improved boolean, best_val double, best_step long, eval_idx long, no_improve long")
    schema = T.StructType([f for f in d.schema.fields if f.name not in (_R, *added.names)] + added.fields)

    def fill(table: pa.Table, states: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("step", "ascending")])
        states = states.sort_by([("run", "ascending")])      # one for each stretch, in the same order
        came = [states.column(c).to_numpy() for c in ("v", "step", "idx", "off")]
        v = table.column(value).cast(pa.float64()).fill_null(float("nan")).to_numpy().astype(float)
        step = table.column("step").to_numpy()
        improved, best, at, idx, no = (np.zeros(len(v), t) for t in (bool, float, np.int64, np.int64, np.int64))
        for (_, a, b), *state in zip(_stretches(table), *came, strict=True):
            s = dict(zip(("v", "step", "idx", "off"), state))
            cand, w, following = candidates(v[a:b], delta)
            taken, k = [], int(np.searchsorted(-w, -s["v"], side="right"))
            while k < len(cand):
                taken.append(k)
                k = int(following[k])
            rows = cand[taken]
            improved[a + rows] = True
            n = s["off"] + np.arange(b - a)
            # the last accepted row up to each row, or what came in (place -1)
            last = np.searchsorted(rows, np.arange(b - a), side="right") - 1
            pick = lambda own, came: np.append(own, came)[last]
            best[a:b], at[a:b], idx[a:b] = pick(v[a + rows], s["v"]), pick(step[a + rows], s["step"]), n
            no[a:b] = n - pick(n[rows], s["idx"])
        out = table.select([f.name for f in schema.fields[:-5]])
        for name, column in zip(added.names, (improved, best, at, idx, no)):
            out = out.append_column(name, pa.array(column))
        return out

    return d.groupBy(_R).cogroup(states.groupBy(_R)).applyInArrow(fill, schema)


def stops_from(tracked: DataFrame, patience: int, warmup: int) -> DataFrame:
    """Plateau stop per run from :func:`track_best` rows (see early_stop)."""
    stop = (~F.col("improved")) & (F.col("step") >= warmup) & (F.col("no_improve") >= patience)
    st = F.struct("best_val", "best_step")
    g = tracked.groupBy("run").agg(
        F.min(F.when(stop, F.col("step"))).alias("stop_step"),
        F.min_by(st, F.when(stop, F.col("step"))).alias("_at_stop"),
        F.max_by(st, F.col("step")).alias("_at_end"))
    s = F.coalesce(F.col("_at_stop"), F.col("_at_end"))
    return g.select("run", "stop_step", s["best_val"].alias("best_val"),
                    s["best_step"].alias("best_step"))


def early_stop(evals: DataFrame, patience: int, min_delta: float, warmup: int,
               value: str = "val_ppl") -> DataFrame:
    """Plateau stop per run (G15): the first evaluation with step >= warmup
    and no_improve >= patience (non-improvements during warm-up count; inf
    and NaN never improve). (run, stop_step NULL if none, best_val,
    best_step) with the best state at the stop, or at the last evaluation."""
    return stops_from(track_best(evals, min_delta, value), patience, warmup)


def time_stop(log: DataFrame, max_minutes: float | None, eval_every: int,
              ts_col: str = "ts") -> DataFrame:
    """Time stop per run (G16): the first evaluation step (step % k == 0)
    whose elapsed minutes since the run's first row reach the limit; the
    clock is looked at only at evaluations. (run, time_stop_step)."""
    if max_minutes is None or not eval_every:
        return log.select("run").distinct().withColumn("time_stop_step", F.lit(None).cast("long"))
    t0 = log.groupBy("run").agg(F.min(ts_col).alias("_t0"))
    j = log.join(t0, "run")
    # microseconds between two timestamps: exact, no time-zone conversion
    secs = F.expr(f"timestampdiff(MICROSECOND, _t0, {ts_col})") / F.lit(1e6)
    hit = ((F.col("step") % eval_every) == 0) & (secs / 60.0 >= max_minutes)
    return j.groupBy("run").agg(F.min(F.when(hit, F.col("step"))).alias("time_stop_step"))


def run_end(log: DataFrame, stops: DataFrame, times: DataFrame, steps: int) -> DataFrame:
    """Effective end per run (G17): earliest of the plateau stop, the time
    stop, the step budget and the last logged step. (run, end_step)."""
    last = log.groupBy("run").agg(F.max("step").alias("_last"))
    j = last.join(stops.select("run", "stop_step"), "run", "left").join(times, "run", "left")
    return j.select("run", F.least(F.col("stop_step"), F.col("time_stop_step"),
                                   F.lit(steps).cast("long"), F.col("_last")).alias("end_step"))


def truncate_runs(log: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows after each run's end are cut (G17)."""
    return log.join(ends, "run").filter(F.col("step") <= F.col("end_step")).drop("end_step")


def pick_snapshot(tracked: DataFrame, ends: DataFrame, save_every: int = 0) -> DataFrame:
    """Snapshot choice (G18, G19): the best step seen up to the end, else
    the final step; ``meta_step`` is the last step even when best weights
    are restored. ``n_saves`` counts periodic saves (step % save_every)."""
    t = tracked.join(ends, "run").filter(F.col("step") <= F.col("end_step"))
    g = t.groupBy("run", "end_step").agg(
        F.max(F.when(F.col("improved"), F.col("step"))).alias("best_step"))
    saves = F.floor(F.col("end_step") / F.lit(save_every)).cast("long") if save_every \
        else F.lit(0).cast("long")
    return g.select("run", "best_step", F.col("end_step").alias("last_step"),
                    F.coalesce(F.col("best_step"), F.col("end_step")).alias("snapshot_step"),
                    F.col("end_step").alias("meta_step"), saves.alias("n_saves"))
