"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
whose columns match the SQL oracle of the same name in
:mod:`blockwise.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockwise.operators import corpus as C
from blockwise.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _md5_join(c) -> F.Column:
    return F.md5(F.concat_ws(" ", F.col(c) if isinstance(c, str) else c))


def packed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_offsets(V.tokens(spark, sf_dir), partition_cols=["split"])


def blocks(spark: SparkSession, sf_dir: str, seq_len: int = V.SEQ_LEN) -> DataFrame:
    return C.pack_blocks(packed_docs(spark, sf_dir), seq_len, partition_cols=["split"])


# --------------------------------------------------------------- corpus
@query
def packed_blocks(spark, sf_dir):
    """Flagship: tokenise, add end markers, global offsets, pack into
    shifted blocks of 256; x and y reported as md5 of the joined tokens."""
    b = blocks(spark, sf_dir)
    return b.select("split", "block_id", _md5_join("x").alias("x_md5"),
                    _md5_join("y").alias("y_md5"))


@query
def head_docs(spark, sf_dir):
    """Head caps in source order: train keeps the first 200000 documents,
    validation the first min(20000, 200000)."""
    c = V.corpus(spark, sf_dir).select("split", "doc_id")
    tr = C.head_docs(c.filter(F.col("split") == "train"), 200_000, partition_cols=["split"])
    va = C.head_docs(c.filter(F.col("split") == "validation"), C.validation_cap(200_000),
                     partition_cols=["split"])
    return tr.unionByName(va).select("split", "doc_id", "doc_rank")


@query
def capped_docs(spark, sf_dir):
    """The same caps where they bind: 300 train documents, min(20000, 40)
    validation documents."""
    c = V.corpus(spark, sf_dir).select("split", "doc_id")
    tr = C.head_docs(c.filter(F.col("split") == "train"), 300, partition_cols=["split"])
    va = C.head_docs(c.filter(F.col("split") == "validation"), C.validation_cap(40), partition_cols=["split"])
    return tr.unionByName(va).select("split", "doc_id", "doc_rank")


def word_vocab(spark, sf_dir):
    # a typed end marker would be taken for an appended one
    docs = C.check_special(V.corpus(spark, sf_dir), [C.EOS_TOKEN], mode="error", whole=True)
    return C.build_vocab(C.tokenize_words(docs))


@query
def vocab(spark, sf_dir):
    """Word vocabulary over the whole corpus: ids by count desc, token asc."""
    return word_vocab(spark, sf_dir)


@query
def encode_decode(spark, sf_dir):
    """Encode every document to ids (end marker = vocabulary size), decode
    back, and check the round trip."""
    from blockwise.session import cut
    t = V.tokens(spark, sf_dir).select("doc_id", "toks")
    # the vocabulary feeds four join branches and the ids two consumers:
    # each is written once instead of re-tokenising the corpus per branch
    ve = cut(C.with_eos(word_vocab(spark, sf_dir)))
    enc = cut(C.encode_ids(t, ve))
    dec = C.decode_ids(enc, ve, out="dec")
    j = t.join(enc, "doc_id").join(dec, "doc_id")
    return j.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.md5(F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))))
                    .alias("ids_md5"),
                    (F.col("dec") == F.col("toks")).alias("roundtrip"))


@query
def bpe_tokens(spark, sf_dir):
    """Byte-level BPE ids of every whole document (end id appended), after
    the end-of-text guard."""
    from blockwise.operators.bpe import END_OF_TEXT, bpe_encode
    from blockwise.sources.corpus import spread
    docs = spread(V.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    d = C.check_special(docs, [END_OF_TEXT], mode="error")
    ids = d.select("doc_id", bpe_encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"),
                      F.aggregate("ids", F.lit(0).cast("long"),
                                  lambda a, x: a + x.cast("long")).alias("id_sum"))


def report(spark, sf_dir):
    # counts only: the token arrays are pruned from this plan
    return C.corpus_report(V.tokens(spark, sf_dir), V.SEQ_LEN, V.BATCH)


@query
def corpus_report(spark, sf_dir):
    """Documents, tokens, blocks (L=256) and batches (B=16) per split."""
    return report(spark, sf_dir)


# ------------------------------------------------------------- batching
def _block_ids(spark, sf_dir, split):
    from blockwise.operators.batching import block_ids
    d = C.token_offsets(V.tokens(spark, sf_dir).drop("toks"))      # counts only
    return block_ids(d, V.SEQ_LEN).filter(F.col("split") == split)


def _train_block_ids(spark, sf_dir):
    return _block_ids(spark, sf_dir, "train")


@query
def shuffled_batches(spark, sf_dir):
    """Two epochs of seeded shuffles of the train blocks into batches of 16."""
    from blockwise.operators import batching as Bt
    r = Bt.shuffle_blocks(_train_block_ids(spark, sf_dir), V.SEED, epochs=2)
    return Bt.assign_batches(r, V.BATCH).select("epoch", "batch_id", "slot", "block_id")


@query
def step_schedule(spark, sf_dir):
    """The 1500-step schedule over shuffled train batches."""
    from blockwise.operators import batching as Bt
    s = Bt.schedule(_train_block_ids(spark, sf_dir), V.STEPS, V.BATCH, V.SEED)
    return s.select("step", "epoch", "batch_id", "slot", "block_id")


@query
def eval_batches(spark, sf_dir):
    """Validation batches in order, first min(50, n div 16)."""
    from blockwise.operators import batching as Bt
    b = _block_ids(spark, sf_dir, "validation")
    return Bt.eval_batches(b, V.BATCH, V.VAL_BATCHES).select("batch_id", "slot", "block_id")


@query
def stored_batches(spark, sf_dir):
    """The corpus stored by split and read back, its validation split packed
    into a block store, and the first 3 evaluation batches read from it."""
    from blockwise.session import scratch_path
    from blockwise.sources import blocks as B
    from blockwise.sources.corpus import read_corpus
    base = scratch_path(spark, "store")
    B.write_corpus(V.corpus(spark, sf_dir).select("split", "doc_id", "text"), f"{base}/corpus")
    docs = C.tokenize_words(read_corpus(spark, f"{base}/corpus", "validation"))
    B.write_blocks(C.pack_blocks(C.token_offsets(docs), V.SEQ_LEN), f"{base}/blocks")
    b = B.stored_eval_batches(spark, f"{base}/blocks", "validation", V.BATCH, 3)
    return b.select("batch_id", "slot", "block_id", _md5_join("x").alias("x_md5"), _md5_join("y").alias("y_md5"))


# ------------------------------------------------------------ run logs
def grid_filled(spark, sf_dir):
    from blockwise.operators.runs import ffill_eval
    return ffill_eval(V.grid_log(spark, sf_dir))


@query
def ffill_eval(spark, sf_dir):
    """Forward-filled validation metrics of the 13 sweep runs."""
    f = grid_filled(spark, sf_dir)
    return f.select("run", "step", F.round("val_loss", 6).alias("val_loss"), "val_ppl")


@query
def best_step_finite(spark, sf_dir):
    """Best finite validation ppl and its first step per run."""
    from blockwise.operators.runs import best_step
    return best_step(V.run_log(spark, sf_dir), mode="finite")


@query
def best_step_notna(spark, sf_dir):
    """Best not-missing validation ppl (inf allowed) and step per run."""
    from blockwise.operators.runs import best_step
    return best_step(V.run_log(spark, sf_dir), mode="notna")


@query
def run_summary(spark, sf_dir):
    """One summary row per run of the event log, in run order."""
    from blockwise.operators.runs import summarize_runs
    s = summarize_runs(V.run_log(spark, sf_dir))
    return s.withColumn("last_train_loss", F.round("last_train_loss", 6)).orderBy("run")


@query
def vs_baseline(spark, sf_dir):
    """Final ppl of each sweep run against the baseline run's final ppl."""
    from blockwise.operators.runs import summarize_runs, vs_baseline as vb
    s = vb(summarize_runs(grid_filled(spark, sf_dir)))
    return s.select("run", "final_val_ppl",
                    F.round("ppl_improve_vs_base_pct", 6).alias("ppl_improve_vs_base_pct"))


def cells(spark, sf_dir):
    from blockwise.operators.runs import grid_cells as gc
    return gc(grid_filled(spark, sf_dir), experts=8)


@query
def grid_cells(spark, sf_dir):
    """RJ x CF cells at E = 8: best ppl and step per sweep run."""
    return cells(spark, sf_dir)


@query
def grid_pivot(spark, sf_dir):
    """The RJ x CF grid of best ppl (duplicate cells fail)."""
    from blockwise.operators.runs import grid_pivot as gp
    return gp(cells(spark, sf_dir))


@query
def grid_labels(spark, sf_dir):
    """Two-decimal labels of the finite grid cells."""
    from blockwise.operators.runs import grid_labels as gl
    return gl(cells(spark, sf_dir))


@query
def curves(spark, sf_dir):
    """Validation curves of the RJ x CF runs at the evaluation steps."""
    from blockwise.operators.runs import curves as cv
    return cv(grid_filled(spark, sf_dir), prefix="all_moe_e8_rj", every=V.EVAL_EVERY)


@query
def sweep(spark, sf_dir):
    """The 13-run study table with the rows and evaluations each run logged."""
    from blockwise.operators.runs import sweep as sw
    g = V.grid_log(spark, sf_dir).groupBy("run").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("val_ppl").alias("n_evals"))
    return sw(spark, steps=V.SWEEP_STEPS).join(g, "run", "left").select(
        "run", "kind", "moe_num_experts", "moe_router_jitter", "moe_capacity_factor", "steps",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_evals", F.lit(0)).alias("n_evals"))


@query
def quick_sweep(spark, sf_dir):
    """The 3-run quick study table with the rows and evaluations of its
    runs' logs (a fourth run logged beside it is not in the study)."""
    from blockwise.operators.runs import sweep as sw, sweep_rows
    names = [r[1] for r in sweep_rows(quick=True)] + ["moe_e8_s1500"]
    g = V.grid_log(spark, sf_dir, names).groupBy("run").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("val_ppl").alias("n_evals"))
    return sw(spark, quick=True).join(g, "run", "left").select(
        "launch", "run", "kind", "moe_num_experts", "moe_router_jitter", "moe_capacity_factor", "steps",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_evals", F.lit(0)).alias("n_evals"))


@query
def family_grid(spark, sf_dir):
    """Cells at E = 8 of logs with names of both families: the runs of
    capacity factor 1.25 are named moe_*, the others all_moe_*."""
    from blockwise.operators.runs import grid_cells as gc
    short = F.when(F.col("run").contains("_cf1.25_"), F.regexp_replace("run", "^all_", "")).otherwise(F.col("run"))
    return gc(grid_filled(spark, sf_dir).withColumn("run", short), experts=8)


@query
def run_throughput(spark, sf_dir):
    """Cumulative tokens per second of every logged step (16 x 256 tokens
    per step over the seconds since the run's first row, at least 1e-6) and
    the device memory column read as thousands of bytes and reported in MB."""
    from blockwise.functions.numeric import bytes_to_mb, throughput
    log = V.run_log(spark, sf_dir)
    t0 = log.groupBy("run").agg(F.min("ts").alias("_t0"))
    el = F.expr("timestampdiff(MICROSECOND, _t0, ts)") / F.lit(1e6)
    j = log.join(t0, "run").withColumn("elapsed", el)
    return j.select("run", "step", F.round("elapsed", 6).alias("elapsed"),
                    F.round(throughput(F.col("step"), F.lit(V.BATCH), F.lit(V.SEQ_LEN),
                                       F.col("elapsed")), 4).alias("tok_per_sec"),
                    bytes_to_mb(F.when(~F.isnan("gpu_mem_mb"), F.col("gpu_mem_mb") * 1000.0))
                    .alias("mem_mb"))


@query
def study_summary(spark, sf_dir):
    """The sweep logs written as CSV run folders (fixed header and
    decimals) in the shared folder, then re-summarised from the files:
    inventory, one scan of all logs, summary with baseline comparison."""
    from blockwise.session import scratch_path
    from blockwise.sources.runs import write_metrics
    from blockwise.sources.study import summarize_root
    root = scratch_path(spark, "study")
    write_metrics(grid_filled(spark, sf_dir), root)
    s = summarize_root(spark, root)["summary"]
    return s.select("run", "final_val_ppl", "best_val_ppl", "best_step", "last_train_loss",
                    "max_tok_s", "peak_mem_mb",
                    F.round("ppl_improve_vs_base_pct", 6).alias("ppl_improve_vs_base_pct"))


def _mixed_roots(spark, sf_dir):
    """The sweep logs written as two studies, the all-expert runs with only
    step, train_loss and val_ppl (in another order)."""
    from blockwise.session import cut, scratch_path
    from blockwise.sources.runs import format_metrics, write_metrics
    old, new = scratch_path(spark, "old-logs"), scratch_path(spark, "new-logs")
    log = cut(grid_filled(spark, sf_dir))
    is_old = F.col("run").startswith("all_moe_e")
    few = format_metrics(log.filter(is_old)).select("run", "val_ppl", "step", "train_loss")
    few.write.mode("overwrite").partitionBy("run").option("header", True).csv(old)
    write_metrics(log.filter(~is_old), new)
    return old, new


@query
def mixed_logs(spark, sf_dir):
    """The sweep logs in two layouts, read by each file's own header and
    summarised; a column that a log lacks is NaN."""
    from blockwise.operators.runs import summarize_runs
    from blockwise.sources.runs import read_runs
    old, new = _mixed_roots(spark, sf_dir)
    return summarize_runs(read_runs(spark, old).unionByName(read_runs(spark, new)))


# The study's shared training settings.
STUDY_SETTINGS = {"d_model": 512, "n_layer": 6, "n_head": 8, "seq_len": 256, "batch_size": 16,
                  "bf16": True, "eval_every": 200, "val_batches": 50,
                  "early_stop_patience": 5, "early_stop_min_delta": 0.1,
                  "early_stop_warmup": 400, "seed": 42}


@query
def normalized_configs(spark, sf_dir):
    """Effective layout of every run seen in the sweep logs: defaults, study
    settings and per-run flags, then MoE layer / expert / d_ff rules."""
    from blockwise.operators import runs as R
    seen = V.grid_log(spark, sf_dir).select("run").distinct()
    sw = R.sweep(spark, steps=V.SWEEP_STEPS).join(seen, "run", "left_semi").drop("launch", "kind")
    cfg = R.normalize_configs(R.apply_overrides(R.config_defaults(sw), STUDY_SETTINGS))
    return cfg.select("run", "moe_enabled", "n_experts",
                      F.concat_ws(",", F.transform("moe_layer_list", lambda i: i.cast("string")))
                      .alias("moe_layers"),
                      "d_ff_eff", "moe_capacity_factor", "moe_router_jitter", "steps")


def user_configs(spark, sf_dir):
    """A run config for every user of the event log, its fields from the
    user's number; NULL is an unset field."""
    u = F.col("u")
    one_of = lambda values, n, kind: F.element_at(
        F.array(*[F.lit(v).cast(kind) for v in values]), (n % len(values) + 1).cast("int"))
    return V.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("u")).distinct().select(
        F.concat(F.lit("user_"), u.cast("string")).alias("run"),
        (u % 7 + 2).cast("int").alias("n_layer"), (u % 3 * 64 + 64).cast("int").alias("d_model"),
        one_of([True, None, False], u % 11, "boolean").alias("no_moe"),
        one_of([0, 4, 8, None], u, "int").alias("moe_num_experts"), (u % 5 == 0).alias("moe_all_layers"),
        one_of([None, "", ",", "1, 3,,3", "0,9", "2"], u, "string").alias("moe_layers"),
        F.when(u % 13 != 0, u % 8).cast("int").alias("moe_layer_index"),
        F.when(u % 3 == 1, F.lit(0)).when(u % 3 == 2, u % 100 + 100).cast("int").alias("d_ff"),
        F.when(u % 2 == 0, u % 900).cast("int").alias("steps"))


@query
def config_precedence(spark, sf_dir):
    """Defaults for unset fields, overrides of two fields, then the layer,
    expert and d_ff rules, on configs that take every branch of them."""
    from blockwise.operators import runs as R
    cfg = R.apply_overrides(R.config_defaults(user_configs(spark, sf_dir)), {"n_head": 4, "eval_every": 50})
    return R.normalize_configs(cfg).select(
        "run", "moe_enabled", "n_experts",
        F.concat_ws(",", F.transform("moe_layer_list", lambda i: i.cast("string"))).alias("moe_layers"),
        "d_ff_eff", "n_head", "eval_every", "steps", "seed", "lr", "vocab_name")


@query
def run_meta(spark, sf_dir):
    """Config, log summary and saved best step of every run: configs and
    best steps written as run folders, read back and joined by run."""
    from blockwise.operators import runs as R
    from blockwise.session import cut, scratch_path
    from blockwise.sources import runs as S
    log = cut(grid_filled(spark, sf_dir))
    at = scratch_path(spark, "run-meta")
    cfg = R.apply_overrides(R.config_defaults(R.sweep(spark, steps=V.SWEEP_STEPS)), STUDY_SETTINGS)
    S.write_run_configs(cfg, f"{at}/configs")
    S.write_best_steps(R.best_step(log, mode="notna"), f"{at}/best")
    j = R.join_run_meta(S.read_run_configs(spark, f"{at}/configs"), R.summarize_runs(log),
                        S.read_best_steps(spark, f"{at}/best"))
    return j.select("run", "moe_num_experts", "moe_router_jitter", "moe_capacity_factor", "steps", "d_model",
                    "eval_every", "final_val_ppl", "best_val_ppl", "saved_best_step")


# ------------------------------------------------------------- stopping
# Fixed values of the stopping queries. Patience and min delta are the
# study's; warm-up, step budget, time limit and evaluation interval are
# scaled to the event log (49-99 rows per run, about 30 days per run).
PATIENCE, MIN_DELTA, WARMUP = 5, 0.1, 20
RUN_STEPS, MAX_MINUTES, TIME_EVAL_EVERY, SAVE_EVERY = 60, 30000, 5, 10


def _evals(spark, sf_dir):
    """The evaluation log, ranked once and written once: every stopping
    query reads it several times (best tracking, time stop, run end, cut)."""
    from blockwise.session import cut
    return cut(V.run_log(spark, sf_dir).select("run", "step", "ts", "val_ppl"))


def _tracked(evals):
    from blockwise.operators.stopping import track_best as tb
    return tb(evals, MIN_DELTA)


@query
def track_best(spark, sf_dir):
    """Best tracking with hysteresis (min delta 0.1) over every evaluation."""
    t = _tracked(_evals(spark, sf_dir))
    return t.select("run", "step", "improved", "best_val", "best_step", "no_improve")


def _stops(tracked):
    from blockwise.operators.stopping import stops_from
    return stops_from(tracked, PATIENCE, WARMUP)


@query
def early_stop(spark, sf_dir):
    """Plateau stop per run: patience 5, min delta 0.1, warm-up 20."""
    return _stops(_tracked(_evals(spark, sf_dir)))


def _times(evals):
    from blockwise.operators.stopping import time_stop as ts
    return ts(evals, MAX_MINUTES, TIME_EVAL_EVERY)


@query
def time_stop(spark, sf_dir):
    """First evaluation (every 5th step) at or past 30000 minutes per run."""
    return _times(V.run_log(spark, sf_dir).select("run", "step", "ts", "val_ppl"))


def _ends(evals, tracked):
    from blockwise.operators.stopping import run_end
    return run_end(evals, _stops(tracked), _times(evals), RUN_STEPS)


@query
def truncate_runs(spark, sf_dir):
    """Logs cut at the earliest of plateau stop, time stop and 60 steps."""
    from blockwise.operators.stopping import truncate_runs as tr
    ev = _evals(spark, sf_dir)
    return tr(ev, _ends(ev, _tracked(ev))).select("run", "step", "val_ppl")


@query
def pick_snapshot(spark, sf_dir):
    """Snapshot per run: best step up to the end, else the end; saves
    every 10 steps."""
    from blockwise.operators.stopping import pick_snapshot as ps
    ev = _evals(spark, sf_dir)
    t = _tracked(ev)
    return ps(t, _ends(ev, t), SAVE_EVERY)


# -------------------------------------------------------------- routing
JITTER, CAPACITY, TEMPERATURE = 0.05, 1.0, 0.8


def routed(spark, sf_dir, jitter: float = 0.0):
    from blockwise.operators import routing as R
    lg = R.router_logits(V.vectors(spark, sf_dir), V.router(spark, sf_dir))
    return R.route(R.add_jitter(lg, jitter, V.SEED))


def n_experts(spark, sf_dir) -> int:
    return V.router(spark, sf_dir).count()                       # a count


@query
def route_top1(spark, sf_dir):
    """Top-1 expert and its probability for every vector."""
    r = routed(spark, sf_dir)
    return r.select("vec_id", "batch", "top1", F.round("top1_prob", 6).alias("top1_prob"))


def _stats(spark, sf_dir):
    from blockwise.operators.routing import router_stats as rs
    return rs(routed(spark, sf_dir), n_experts(spark, sf_dir))


@query
def router_stats(spark, sf_dir):
    """Importance and load per batch and expert."""
    s = _stats(spark, sf_dir)
    return s.select("batch", "expert", F.round("importance", 6).alias("importance"),
                    F.round("load", 6).alias("load"))


def _aux(spark, sf_dir):
    from blockwise.operators.routing import aux_loss as al
    return al(_stats(spark, sf_dir), n_experts(spark, sf_dir))


@query
def aux_loss(spark, sf_dir):
    """Balance loss per batch (1.0 when balanced)."""
    return _aux(spark, sf_dir).select("batch", F.round("aux", 6).alias("aux"))


def _ce(spark, sf_dir):
    from blockwise.operators.scoring import token_ce as tc
    return tc(routed(spark, sf_dir).withColumn("target", F.col("label")))


@query
def total_loss(spark, sf_dir):
    """Per batch: mean cross-entropy (target = label), balance loss and
    ce + 0.01 * aux."""
    from blockwise.operators.routing import total_loss as tl
    ce = _ce(spark, sf_dir).groupBy("batch").agg(F.avg("ce").alias("ce"))
    t = tl(ce, _aux(spark, sf_dir))
    return t.select("batch", *[F.round(c, 6).alias(c) for c in ("ce", "aux", "total")])


@query
def router_jitter(spark, sf_dir):
    """Routing with jitter 0.05 (hash-seeded normals, seed 42)."""
    r = routed(spark, sf_dir, JITTER)
    return r.select("vec_id", "batch", "top1", F.round("top1_prob", 6).alias("top1_prob"))


def _capped(spark, sf_dir):
    from blockwise.operators.routing import apply_capacity
    return apply_capacity(routed(spark, sf_dir), CAPACITY, n_experts(spark, sf_dir))


@query
def capacity_dispatch(spark, sf_dir):
    """Capacity cap ceil(1.0 * rows / E) per batch and expert, in vec_id order."""
    c = _capped(spark, sf_dir)
    return c.select("vec_id", "batch", F.col("top1").alias("expert"), "kept")


@query
def dispatch_report(spark, sf_dir):
    """Routed / kept / dropped / drop rate per batch and expert, per expert
    and overall."""
    from blockwise.operators.routing import dispatch_report as dr
    d = dr(_capped(spark, sf_dir))
    return d.withColumn("drop_rate", F.round("drop_rate", 6))


def _scored(spark, sf_dir):
    from blockwise.operators.scoring import expert_weights, score_experts
    w = expert_weights(V.router(spark, sf_dir), 64, 256, V.SEED)
    return score_experts(_capped(spark, sf_dir).filter("kept"), w)


def _digest(vec):
    """md5 of the elements in order, in millionths."""
    return F.md5(F.array_join(F.transform(vec, lambda v: F.round(v * 1e6).cast("bigint").cast("string")), ","))


@query
def expert_scores(spark, sf_dir):
    """Gated expert feed-forward outputs of the kept rows (d_ff 256)."""
    from blockwise.functions.arrays import array_sum
    s = _scored(spark, sf_dir)
    return s.select("vec_id", F.col("top1").alias("expert"), F.round(array_sum("y"), 6).alias("y_sum"),
                    _digest("y").alias("y_md5"))


@query
def moe_combine(spark, sf_dir):
    """Residual combine: x + gated expert output; dropped rows pass unchanged."""
    from blockwise.functions.arrays import array_sum
    from blockwise.operators.routing import combine
    x = _capped(spark, sf_dir).select("vec_id", "vec", "kept")
    out = combine(x, _scored(spark, sf_dir))
    return out.select("vec_id", "kept", F.round(array_sum("out"), 6).alias("out_sum"), _digest("out").alias("out_md5"))


@query
def layer_norm(spark, sf_dir):
    """Row-vector layer norm of every embedding (eps 1e-5, gain 1, bias 0)."""
    from blockwise.functions.arrays import array_sum, layer_norm as ln
    e = V.vectors(spark, sf_dir).withColumn("y", ln("vec"))
    return e.select("vec_id", F.round(F.array_min("y"), 6).alias("y_min"),
                    F.round(F.array_max("y"), 6).alias("y_max"),
                    F.round(array_sum(F.transform("y", lambda v: F.abs(v))), 6).alias("y_l1"))


EMB_SEQ = 64


@query
def scaled_layer_norm(spark, sf_dir):
    """Layer norm of every embedding with gain 1 + i / 64 and bias i / 100."""
    from blockwise.functions.arrays import layer_norm as ln
    gain = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 1 + i / 64)
    bias = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / 100)
    e = V.vectors(spark, sf_dir).withColumn("y", ln("vec", gain=gain, bias=bias))
    return e.select("vec_id", _digest("y").alias("y_md5"))


@query
def recent_tokens(spark, sf_dir):
    """The last 40 tokens of every document (a context cut), fewer where it has fewer."""
    from blockwise.functions.numeric import last_n
    t = V.tokens(spark, sf_dir).withColumn("last", last_n("toks", 40))
    return t.select("doc_id", F.size("last").cast("long").alias("n_last"), _md5_join("last").alias("last_md5"))


@query
def layered_loss(spark, sf_dir):
    """Per batch: cross-entropy and the balance losses of two routed layers
    (without and with jitter), summed with weight 0.01."""
    from blockwise.operators.routing import aux_loss as al, router_stats as rs, total_loss as tl
    E = n_experts(spark, sf_dir)
    layers = [al(rs(routed(spark, sf_dir, j), E), E) for j in (0.0, JITTER)]
    ce = _ce(spark, sf_dir).groupBy("batch").agg(F.avg("ce").alias("ce"))
    t = tl(ce, layers[0].unionByName(layers[1]))
    return t.select("batch", *[F.round(c, 6).alias(c) for c in ("ce", "aux", "total")])


@query
def embed_tokens(spark, sf_dir):
    """Every corpus token as token vector + position vector: the whole
    embeddings table is the token table (row = vocabulary id modulo its row
    count), the position inside a block of 64 selects a positional row
    (embeddings with vec_id < 64, a seq_len-row table)."""
    from blockwise.functions.arrays import array_sum
    from blockwise.operators import corpus as Cc
    from blockwise.operators.routing import embed_tokens as et
    from blockwise.session import cut
    docs = Cc.check_special(V.corpus(spark, sf_dir, place=True), [Cc.EOS_TOKEN], whole=True)
    # counts alone are put in order; the texts stay where they are and are split after they got their offset
    n = cut(Cc.tokenize_words(docs).select("split", "doc_id", "file", "row", "n"))
    d = Cc.tokenize_words(Cc.put_starts(docs, Cc.token_offsets(n)))
    v = cut(word_vocab(spark, sf_dir))                            # read by both sides of the join
    t = (d.select("split", "doc_id", "start", F.posexplode("toks").alias("i", "tok"))
          .select("split", "doc_id", (F.col("start") + F.col("i")).alias("gpos"), "tok"))
    t = Cc._hot_cold_join(t, Cc.with_eos(v), "tok", Cc.HOT_TOKENS, (Cc.EOS_TOKEN,))
    vec = V.vectors(spark, sf_dir)
    n_emb, n_tok = vec.count(), v.count()                         # counts
    t = (t.withColumn("emb_id", F.col("id") % F.lit(n_emb))
          .withColumn("pos", F.col("gpos") % EMB_SEQ))
    emb = vec.select(F.col("vec_id").alias("emb_id"), "vec")
    pos = vec.filter(F.col("vec_id") < EMB_SEQ).select(F.col("vec_id").alias("pos"),
                                                      F.col("vec").alias("pvec"))
    # ids are frequency ranks and keep their number below n_emb; the end marker's is the last one
    x = et(t, emb, pos, EMB_SEQ, out="emb_sum", value=lambda x: F.round(array_sum(x), 6),
           frequent=lambda k: (F.col("emb_id") < k - 1) | (F.col("emb_id") == (n_tok % n_emb if n_emb else None)))
    return x.select("split", "doc_id", "gpos", "emb_id", "pos", "emb_sum")


# ------------------------------------------------------------ scoring
@query
def token_ce(spark, sf_dir):
    """Cross-entropy of router logits against the label, per vector."""
    return _ce(spark, sf_dir).select("vec_id", "batch", F.round("ce", 6).alias("ce"))


@query
def eval_loss(spark, sf_dir):
    """Mean of full-batch mean cross-entropies over the first 50 batches,
    and its guarded perplexity."""
    from blockwise.operators.scoring import eval_loss as el
    e = el(_ce(spark, sf_dir), V.VEC_BATCH, V.VAL_BATCHES)
    return e.select(F.round("val_loss", 6).alias("val_loss"),
                    F.round("val_ppl", 3).alias("val_ppl"), "n_batches")


@query
def capped_eval_loss(spark, sf_dir):
    """The same over the first 3 batches only: the cap binds."""
    from blockwise.operators.scoring import eval_loss as el
    e = el(_ce(spark, sf_dir), V.VEC_BATCH, 3)
    return e.select(F.round("val_loss", 6).alias("val_loss"),
                    F.round("val_ppl", 3).alias("val_ppl"), "n_batches")


def _bigrams(toks):
    from blockwise.operators.scoring import fit_bigrams
    return fit_bigrams(toks.filter(F.col("split") == "train"))


@query
def bigram_fit(spark, sf_dir):
    """Bigram counts over the train documents (no end markers)."""
    return _bigrams(V.tokens(spark, sf_dir, eos=False))


def _nll(spark, sf_dir):
    from blockwise.operators.scoring import score_heldout
    from blockwise.session import cut
    # the words feed the vocabulary's size, the model and both sides of the scoring
    toks = cut(V.tokens(spark, sf_dir, eos=False).select("doc_id", "split", "lang", "source", "toks"), "zstd")
    n_vocab = toks.select(F.explode("toks")).distinct().count()         # the corpus vocabulary's size
    return score_heldout(toks.filter(F.col("split") == "validation"), _bigrams(toks), 1.0,
                         keep=("doc_id", "lang", "source"), n_vocab=n_vocab)


@query
def heldout_ppl(spark, sf_dir):
    """Add-one smoothed bigram loss and perplexity per validation document."""
    from blockwise.operators.scoring import heldout_loss
    h = heldout_loss(_nll(spark, sf_dir), ["doc_id"])
    return h.select("doc_id", "n_pairs", F.round("loss", 6).alias("loss"),
                    F.round("ppl", 3).alias("ppl"))


@query
def heldout_slices(spark, sf_dir):
    """The same loss by language, by source and overall (grouping sets)."""
    from blockwise.functions.numeric import perplexity
    n = _nll(spark, sf_dir)
    g = n.groupingSets([["lang"], ["source"], []], "lang", "source").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("nll").alias("loss"))
    return g.select("lang", "source", "n_pairs", F.round("loss", 6).alias("loss"),
                    F.round(perplexity("loss"), 3).alias("ppl"))


@query
def temperature_draw(spark, sf_dir):
    """Seeded draw of an expert per vector from softmax(logits / 0.8); the
    context is cut to the last 64 dimensions first (seq_len 64)."""
    from blockwise.functions.numeric import last_n
    from blockwise.operators import routing as R
    from blockwise.operators.scoring import temperature_draw as td
    v = V.vectors(spark, sf_dir).withColumn("vec", last_n("vec", EMB_SEQ))
    lg = R.router_logits(v, V.router(spark, sf_dir))
    d = td(lg, TEMPERATURE, V.SEED)
    return d.select("vec_id", "draw", F.round("p_draw", 6).alias("p_draw"))


# ------------------------------------------------------------ streaming
CHUNK_STEPS = 25        # steps of a run in one part of a replayed log


@query
def live_early_stop(spark, sf_dir):
    """The event run log written as parts in step order, replayed through
    the streaming plateau monitor (availableNow); its 'stop' events."""
    from blockwise.session import cut, scratch_path
    from blockwise.streaming import metrics as S
    base = scratch_path(spark, "live-early-stop")
    # ranked once; the chunks are step ranges of it
    S.write_chunks(cut(V.run_log(spark, sf_dir).select("run", "step", "val_ppl")), f"{base}/parts", CHUNK_STEPS)
    ev = S.stream_early_stop(S.stream_metrics(spark, f"{base}/parts", files_per_batch=8),
                             PATIENCE, MIN_DELTA, WARMUP)
    S.run_to_end(ev, f"{base}/events", f"{base}/checkpoint")
    e = spark.read.schema(S.EVENT_SCHEMA).parquet(f"{base}/events")
    return e.filter(F.col("event") == "stop").select(
        "run", F.col("step").alias("stop_step"), F.col("best_val"), "best_step")


@query
def live_run_end(spark, sf_dir):
    """The same log replayed through the live end monitor: the step at which
    the plateau stop, the time stop or the step budget ends each run, else
    its last step."""
    from blockwise.session import cut, scratch_path
    from blockwise.streaming import metrics as S
    base = scratch_path(spark, "live-run-end")
    log = cut(V.run_log(spark, sf_dir).select("run", "step", "ts", "val_ppl"))
    S.write_chunks(log, f"{base}/parts", CHUNK_STEPS)
    ends = S.stream_run_end(S.stream_metrics(spark, f"{base}/parts", schema=log.schema, files_per_batch=8),
                            PATIENCE, MIN_DELTA, WARMUP, MAX_MINUTES, TIME_EVAL_EVERY, RUN_STEPS)
    S.run_to_end(ends, f"{base}/ends", f"{base}/checkpoint")
    e = spark.read.schema("run string, step long, reason string").parquet(f"{base}/ends")
    last = log.groupBy("run").agg(F.max("step").alias("last"))
    return last.join(e, "run", "left").select("run", F.coalesce("step", "last").alias("end_step"))


@query
def streamed_logs(spark, sf_dir):
    """The sweep logs in two layouts (see mixed_logs) streamed as whole files
    by their own headers into a live log, which is read back and summarised."""
    from blockwise.operators.runs import summarize_runs
    from blockwise.session import scratch_path
    from blockwise.sources.runs import read_runs
    from blockwise.streaming import metrics as S
    live = scratch_path(spark, "live-log")
    for name, root in zip(("old", "new"), _mixed_roots(spark, sf_dir)):
        S.ingest_logs(S.stream_log_lines(spark, root), S.live_log(f"{live}/{name}"), f"{live}/checkpoint-{name}")
    logs = [read_runs(spark, f"{live}/{name}", S.LIVE_GLOB) for name in ("old", "new")]
    return summarize_runs(logs[0].unionByName(logs[1]))
