"""DuckDB SQL oracles, one per registered query, over the driver tables
(pre-registered views). Shared view definitions are CTE snippets here, in
the same form as :mod:`blockwise.plans.views`."""

from __future__ import annotations

CORPUS = """corpus AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split,
         text, lang, source FROM documents)"""

TOKENS = CORPUS + """,
toks AS (
  SELECT doc_id, split, lang, source,
         list_append(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+'), '<eos>') AS t
  FROM corpus),
flat AS (
  SELECT doc_id, split, lang, source, generate_subscripts(t, 1) AS i, unnest(t) AS tok FROM toks),
pos AS (
  SELECT doc_id, split, i, tok,
         row_number() OVER (PARTITION BY split ORDER BY doc_id, i) - 1 AS p FROM flat)"""

SQL: dict[str, str] = {}

SQL["packed_blocks"] = "WITH " + TOKENS + """,
nb AS (SELECT split, count(*) // 256 - 1 AS nb FROM pos GROUP BY split),
xs AS (SELECT split, p // 256 AS block_id, md5(string_agg(tok, ' ' ORDER BY p)) AS x_md5
       FROM pos GROUP BY 1, 2),
ys AS (SELECT split, (p - 1) // 256 AS block_id, md5(string_agg(tok, ' ' ORDER BY p)) AS y_md5
       FROM pos WHERE p >= 1 GROUP BY 1, 2)
SELECT xs.split, xs.block_id, x_md5, y_md5
FROM xs JOIN ys USING (split, block_id) JOIN nb USING (split)
WHERE xs.block_id < nb.nb
"""

SQL["head_docs"] = "WITH " + CORPUS + """,
r AS (SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS doc_rank
      FROM corpus)
SELECT split, doc_id, doc_rank FROM r
WHERE doc_rank < CASE WHEN split = 'train' THEN 200000 ELSE 20000 END
"""

SQL["capped_docs"] = SQL["head_docs"].replace("200000", "300").replace("20000", "40")

VOCAB = TOKENS + """,
vc AS (SELECT tok, count(*) AS count FROM flat WHERE tok <> '<eos>' GROUP BY tok),
v AS (SELECT tok, count, row_number() OVER (ORDER BY count DESC, tok) - 1 AS id FROM vc)"""

SQL["vocab"] = "WITH " + VOCAB + "\nSELECT tok, count, id FROM v"

SQL["encode_decode"] = "WITH " + VOCAB + """,
ve AS (SELECT tok, id FROM v UNION ALL SELECT '<eos>', (SELECT count(*) FROM v)),
enc AS (SELECT f.doc_id, f.i, f.tok, ve.id FROM flat f LEFT JOIN ve USING (tok)),
dec AS (SELECT e.doc_id, e.i, e.tok AS orig, d.tok AS back, e.id
        FROM enc e LEFT JOIN ve d ON d.id = e.id)
SELECT doc_id, count(*) AS n_tokens,
       md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i)) AS ids_md5,
       bool_and(coalesce(orig = back, false)) AS roundtrip
FROM dec GROUP BY doc_id
"""

# With byte-level ranks the ids are the UTF-8 bytes; their sum is computed
# from code points (1-4 byte forms), plus the end id 256.
SQL["bpe_tokens"] = """
WITH cps AS (SELECT doc_id, coalesce(text, '') AS t,
                    list_transform(string_split(coalesce(text, ''), ''), lambda c: unicode(c)) AS cp
             FROM documents)
SELECT doc_id, octet_length(encode(t)) + 1 AS n_ids,
       CAST(coalesce(list_sum(list_transform(cp, lambda c:
         CASE WHEN c < 128 THEN c
              WHEN c < 2048 THEN (192 + (c >> 6)) + (128 + (c & 63))
              WHEN c < 65536 THEN (224 + (c >> 12)) + (128 + ((c >> 6) & 63)) + (128 + (c & 63))
              ELSE (240 + (c >> 18)) + (128 + ((c >> 12) & 63)) + (128 + ((c >> 6) & 63))
                   + (128 + (c & 63)) END)), 0) + 256 AS BIGINT) AS id_sum
FROM cps
"""

REPORT = TOKENS + """,
rep AS (SELECT split, count(DISTINCT doc_id) AS n_docs, count(*) AS n_tokens,
               greatest(count(*) // 256 - 1, 0) AS n_blocks FROM pos GROUP BY split)"""

SQL["corpus_report"] = "WITH " + REPORT + """
SELECT split, n_docs, n_tokens, n_blocks, n_blocks // 16 AS n_batches FROM rep
"""

BLOCKS = REPORT + """,
tb AS (SELECT split, unnest(range(n_blocks)) AS block_id FROM rep WHERE n_blocks > 0)"""

SQL["shuffled_batches"] = "WITH " + BLOCKS + """,
e AS (SELECT block_id, unnest([0, 1]) AS epoch FROM tb WHERE split = 'train'),
r AS (SELECT epoch, block_id, row_number() OVER (PARTITION BY epoch ORDER BY
        md5('42:' || epoch || ':' || block_id), block_id) - 1 AS rnk,
        count(*) OVER (PARTITION BY epoch) AS n FROM e)
SELECT epoch, rnk // 16 AS batch_id, rnk % 16 AS slot, block_id FROM r
WHERE rnk // 16 < n // 16
"""

SQL["step_schedule"] = "WITH " + BLOCKS + """,
nb AS (SELECT count(*) // 16 AS nb FROM tb WHERE split = 'train'),
e AS (SELECT block_id, unnest(range(CAST(ceil(1500 / nb) AS BIGINT))) AS epoch
      FROM tb, nb WHERE split = 'train'),
r AS (SELECT epoch, block_id, row_number() OVER (PARTITION BY epoch ORDER BY
        md5('42:' || epoch || ':' || block_id), block_id) - 1 AS rnk FROM e),
st AS (SELECT s AS step, s // nb AS epoch, s % nb AS batch_id FROM range(1500) t(s), nb)
SELECT st.step, CAST(st.epoch AS INTEGER) AS epoch, st.batch_id, r.rnk % 16 AS slot, r.block_id
FROM st JOIN r ON r.epoch = st.epoch AND r.rnk // 16 = st.batch_id
"""

SQL["stored_batches"] = "WITH packed AS (" + SQL["packed_blocks"] + """),
pv AS (SELECT *, count(*) OVER () AS n FROM packed WHERE split = 'validation')
SELECT block_id // 16 AS batch_id, block_id % 16 AS slot, block_id, x_md5, y_md5 FROM pv
WHERE block_id // 16 < least(3, n // 16)
"""

SQL["eval_batches"] = "WITH " + BLOCKS + """,
vb AS (SELECT block_id, count(*) OVER () AS n FROM tb WHERE split = 'validation')
SELECT block_id // 16 AS batch_id, block_id % 16 AS slot, block_id FROM vb
WHERE block_id // 16 < least(50, n // 16)
"""

# The 13 sweep run names by launch order (user_id % 13).
SWEEP_LIST = ("['baseline_s10000', 'all_moe_e4_s10000', 'all_moe_e8_s10000', "
              "'all_moe_e16_s10000', 'all_moe_e8_rj0.0_cf1.0_s10000', "
              "'all_moe_e8_rj0.0_cf1.25_s10000', 'all_moe_e8_rj0.0_cf1.5_s10000', "
              "'all_moe_e8_rj0.01_cf1.0_s10000', 'all_moe_e8_rj0.01_cf1.25_s10000', "
              "'all_moe_e8_rj0.01_cf1.5_s10000', 'all_moe_e8_rj0.05_cf1.0_s10000', "
              "'all_moe_e8_rj0.05_cf1.25_s10000', 'all_moe_e8_rj0.05_cf1.5_s10000']")


def _metric_log(run_expr: str) -> str:
    return f"""ev AS (SELECT event_id, ts, event_type, value, {run_expr} AS run FROM events),
rl AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS step,
              ts, event_type, value,
              CASE WHEN event_type = 'error' THEN 'inf'::DOUBLE
                   WHEN event_type = 'signup' THEN 'nan'::DOUBLE ELSE value END AS vp
       FROM ev),
mlog AS (SELECT run, step, ts, ln(1 + value) AS train_loss, value / 100e0 AS aux,
                ln(vp) AS val_loss, vp AS val_ppl, value * 100e0 AS tokens_per_sec,
                CASE WHEN event_type = 'view' THEN 'nan'::DOUBLE
                     ELSE round(value * 8e0, 1) END AS gpu_mem_mb
         FROM rl)"""


RUN_LOG = _metric_log("'user_' || user_id") + """,
run_log AS (SELECT * FROM mlog)"""

GRID_LOG = _metric_log(f"({SWEEP_LIST})[user_id % 13 + 1]") + """,
grid_log AS (SELECT run, step, ts, train_loss, aux,
                    CASE WHEN step % 20 = 0 THEN val_loss END AS val_loss,
                    CASE WHEN step % 20 = 0 THEN val_ppl END AS val_ppl,
                    tokens_per_sec, gpu_mem_mb FROM mlog),
gf AS (SELECT run, step, ts, train_loss, aux, tokens_per_sec, gpu_mem_mb,
              coalesce(last_value(val_loss IGNORE NULLS) OVER w, 'nan'::DOUBLE) AS val_loss,
              coalesce(last_value(val_ppl IGNORE NULLS) OVER w, 'nan'::DOUBLE) AS val_ppl
       FROM grid_log
       WINDOW w AS (PARTITION BY run ORDER BY step
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SQL["ffill_eval"] = "WITH " + GRID_LOG + """
SELECT run, step, round(val_loss, 6) AS val_loss, val_ppl FROM gf
"""


def _best(table: str, keep: str, missing_step: str) -> str:
    return f"""b AS (SELECT run, min(val_ppl) FILTER (WHERE {keep}) AS bv FROM {table} GROUP BY run),
bs AS (SELECT b.run, b.bv, min(t.step) FILTER (WHERE t.val_ppl = b.bv AND {keep.replace('val_ppl', 't.val_ppl')}) AS st
       FROM b JOIN {table} t USING (run) GROUP BY b.run, b.bv)
SELECT run, coalesce(bv, 'nan'::DOUBLE) AS best_val_ppl, {missing_step} AS best_step FROM bs"""


SQL["best_step_finite"] = "WITH " + RUN_LOG + ",\n" + _best(
    "run_log", "isfinite(val_ppl)", "coalesce(CAST(st AS DOUBLE), 'nan'::DOUBLE)")

SQL["best_step_notna"] = "WITH " + RUN_LOG + ",\n" + _best(
    "run_log", "NOT isnan(val_ppl)", "coalesce(st, -1)")


def _summary(table: str) -> str:
    return f"""summ AS (
  SELECT run,
         coalesce(arg_max(val_ppl, step) FILTER (WHERE isfinite(val_ppl)), 'nan'::DOUBLE) AS final_val_ppl,
         coalesce(min(val_ppl) FILTER (WHERE isfinite(val_ppl)), 'nan'::DOUBLE) AS best_val_ppl,
         arg_max(train_loss, step) AS last_train_loss,
         coalesce(max(tokens_per_sec) FILTER (WHERE NOT isnan(tokens_per_sec)), 'nan'::DOUBLE) AS max_tok_s,
         coalesce(max(gpu_mem_mb) FILTER (WHERE NOT isnan(gpu_mem_mb)), 'nan'::DOUBLE) AS peak_mem_mb
  FROM {table} GROUP BY run),
summ2 AS (
  SELECT s.*, coalesce(CAST((SELECT min(t.step) FROM {table} t WHERE t.run = s.run
                             AND t.val_ppl = s.best_val_ppl) AS DOUBLE), 'nan'::DOUBLE) AS best_step
  FROM summ s)"""


SQL["run_summary"] = "WITH " + RUN_LOG + ",\n" + _summary("run_log") + """
SELECT run, final_val_ppl, best_val_ppl, best_step, round(last_train_loss, 6) AS last_train_loss,
       max_tok_s, peak_mem_mb FROM summ2
"""

SQL["vs_baseline"] = "WITH " + GRID_LOG + ",\n" + _summary("gf") + """,
base AS (SELECT arg_max(final_val_ppl, run) AS bp FROM summ WHERE run LIKE '%baseline%')
SELECT run, final_val_ppl,
       round(CASE WHEN isfinite(bp) THEN (bp - final_val_ppl) / bp * 100e0 END, 6)
         AS ppl_improve_vs_base_pct
FROM summ, base
"""

RUN_PATTERN = r"^(?:all_)?moe_e(\d+)_rj([\d\.]+)_cf([\d\.]+)_s(\d+)/?$"

CELLS = GRID_LOG + f""",
pr AS (SELECT DISTINCT run FROM gf),
parsed AS (SELECT run, TRY_CAST(regexp_extract(run, '{RUN_PATTERN}', 1) AS INTEGER) AS e,
                  TRY_CAST(regexp_extract(run, '{RUN_PATTERN}', 2) AS DOUBLE) AS rj,
                  TRY_CAST(regexp_extract(run, '{RUN_PATTERN}', 3) AS DOUBLE) AS cf
           FROM pr WHERE regexp_matches(run, '{RUN_PATTERN}')),
cb AS (SELECT run, min(val_ppl) FILTER (WHERE NOT isnan(val_ppl)) AS bv FROM gf GROUP BY run),
cells AS (SELECT p.run, p.rj, p.cf, coalesce(cb.bv, 'nan'::DOUBLE) AS best_ppl,
                 coalesce((SELECT min(step) FROM gf WHERE gf.run = p.run AND gf.val_ppl = cb.bv), -1)
                   AS best_step
          FROM parsed p JOIN cb USING (run) WHERE p.e = 8)"""

SQL["grid_cells"] = "WITH " + CELLS + "\nSELECT run, rj, cf, best_ppl, best_step FROM cells"

SQL["grid_pivot"] = "WITH " + CELLS + """
SELECT rj, max(best_ppl) FILTER (WHERE cf = 1.0e0) AS cf_1_0,
       max(best_ppl) FILTER (WHERE cf = 1.25e0) AS cf_1_25,
       max(best_ppl) FILTER (WHERE cf = 1.5e0) AS cf_1_5
FROM cells GROUP BY rj
"""

SQL["grid_labels"] = "WITH " + CELLS + """
SELECT rj, cf, printf('%.2f', best_ppl) AS label FROM cells WHERE isfinite(best_ppl)
"""

SQL["curves"] = "WITH " + GRID_LOG + """
SELECT run, step, val_ppl FROM gf
WHERE starts_with(run, 'all_moe_e8_rj') AND step % 20 = 0 AND NOT isnan(val_ppl)
"""

SWEEP_VALUES = """sw(run, kind, moe_num_experts, moe_router_jitter, moe_capacity_factor, steps, no_moe) AS (
  VALUES ('baseline_s10000', 'baseline', 0, NULL::DOUBLE, NULL::DOUBLE, 10000, true),
         ('all_moe_e4_s10000', 'experts', 4, NULL, NULL, 10000, false),
         ('all_moe_e8_s10000', 'experts', 8, NULL, NULL, 10000, false),
         ('all_moe_e16_s10000', 'experts', 16, NULL, NULL, 10000, false),
         ('all_moe_e8_rj0.0_cf1.0_s10000', 'grid', 8, 0.0e0, 1.0e0, 10000, false),
         ('all_moe_e8_rj0.0_cf1.25_s10000', 'grid', 8, 0.0e0, 1.25e0, 10000, false),
         ('all_moe_e8_rj0.0_cf1.5_s10000', 'grid', 8, 0.0e0, 1.5e0, 10000, false),
         ('all_moe_e8_rj0.01_cf1.0_s10000', 'grid', 8, 0.01e0, 1.0e0, 10000, false),
         ('all_moe_e8_rj0.01_cf1.25_s10000', 'grid', 8, 0.01e0, 1.25e0, 10000, false),
         ('all_moe_e8_rj0.01_cf1.5_s10000', 'grid', 8, 0.01e0, 1.5e0, 10000, false),
         ('all_moe_e8_rj0.05_cf1.0_s10000', 'grid', 8, 0.05e0, 1.0e0, 10000, false),
         ('all_moe_e8_rj0.05_cf1.25_s10000', 'grid', 8, 0.05e0, 1.25e0, 10000, false),
         ('all_moe_e8_rj0.05_cf1.5_s10000', 'grid', 8, 0.05e0, 1.5e0, 10000, false))"""

SQL["sweep"] = "WITH " + GRID_LOG + ",\n" + SWEEP_VALUES + """,
g AS (SELECT run, count(*) AS n_rows, count(val_ppl) AS n_evals FROM grid_log GROUP BY run)
SELECT sw.run, kind, moe_num_experts, moe_router_jitter, moe_capacity_factor, steps,
       coalesce(n_rows, 0) AS n_rows, coalesce(n_evals, 0) AS n_evals
FROM sw LEFT JOIN g USING (run)
"""

SQL["normalized_configs"] = "WITH " + GRID_LOG + ",\n" + SWEEP_VALUES + """
SELECT run, NOT no_moe AS moe_enabled, CASE WHEN no_moe THEN 0 ELSE moe_num_experts END AS n_experts,
       CASE WHEN no_moe THEN '' ELSE '0,1,2,3,4,5' END AS moe_layers, 2048 AS d_ff_eff,
       moe_capacity_factor, coalesce(moe_router_jitter, 0.0e0) AS moe_router_jitter, steps
FROM sw WHERE run IN (SELECT run FROM grid_log)
"""

# The quick study's runs and one more, by user_id % 4.
QUICK_VALUES = """sw(launch, run, kind, moe_num_experts, moe_router_jitter, moe_capacity_factor, steps) AS (
  VALUES (0, 'baseline_s1500', 'baseline', 0, NULL::DOUBLE, NULL::DOUBLE, 1500),
         (1, 'all_moe_e8_s1500', 'experts', 8, NULL, NULL, 1500),
         (2, 'all_moe_e8_rj0.0_cf1.5_s1500', 'grid', 8, 0.0e0, 1.5e0, 1500)),
n AS (SELECT user_id % 4 AS launch, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS step
      FROM events)"""

SQL["quick_sweep"] = "WITH " + QUICK_VALUES + """,
g AS (SELECT launch, count(*) AS n_rows, count(*) FILTER (WHERE step % 20 = 0) AS n_evals FROM n GROUP BY launch)
SELECT sw.*, coalesce(n_rows, 0) AS n_rows, coalesce(n_evals, 0) AS n_evals FROM sw LEFT JOIN g USING (launch)
"""

SQL["family_grid"] = "WITH " + CELLS + """
SELECT CASE WHEN cf = 1.25e0 THEN substr(run, 5) ELSE run END AS run, rj, cf, best_ppl, best_step FROM cells
"""

SQL["config_precedence"] = """
WITH c AS (SELECT DISTINCT user_id AS u FROM events),
f AS (SELECT u, CAST(u % 7 + 2 AS INTEGER) AS n_layer, CAST(u % 3 * 64 + 64 AS INTEGER) AS d_model,
             u % 11 % 3 = 0 AS no_moe, ([0, 4, 8, 8])[u % 4 + 1] AS experts, u % 5 = 0 AS every_layer,
             (['', '', ',', '1, 3,,3', '0,9', '2'])[u % 6 + 1] AS listed,
             CAST(CASE WHEN u % 13 = 0 THEN 3 ELSE u % 8 END AS INTEGER) AS single,
             CAST(CASE WHEN u % 3 = 2 THEN u % 100 + 100 ELSE 0 END AS INTEGER) AS d_ff FROM c),
l AS (SELECT *, CASE WHEN every_layer THEN range(n_layer)
                     WHEN listed <> '' THEN list_transform(
                       list_filter(list_transform(string_split(listed, ','), lambda s: trim(s)), lambda s: s <> ''),
                       lambda s: CAST(s AS BIGINT))
                     ELSE [CAST(single AS BIGINT)] END AS chosen FROM f)
SELECT 'user_' || u AS run, NOT (no_moe OR experts = 0) AS moe_enabled,
       CASE WHEN no_moe OR experts = 0 THEN 0 ELSE experts END AS n_experts,
       CASE WHEN no_moe OR experts = 0 THEN ''
            ELSE coalesce(array_to_string(list_sort(list_distinct(list_filter(chosen, lambda i: i >= 0 AND i < n_layer))), ','), '')
            END AS moe_layers,
       CASE WHEN d_ff = 0 THEN 4 * d_model ELSE d_ff END AS d_ff_eff, 4 AS n_head, 50 AS eval_every,
       CAST(CASE WHEN u % 2 = 0 THEN u % 900 ELSE 1500 END AS INTEGER) AS steps, 42 AS seed, 3e-4 AS lr,
       'gpt2' AS vocab_name
FROM l
"""

SQL["run_meta"] = "WITH " + GRID_LOG + ",\n" + SWEEP_VALUES + ",\n" + _summary("gf") + """,
nb AS (SELECT run, min(val_ppl) FILTER (WHERE NOT isnan(val_ppl)) AS bv FROM gf GROUP BY run),
nbs AS (SELECT run, coalesce((SELECT min(step) FROM gf WHERE gf.run = nb.run AND gf.val_ppl = nb.bv), -1)
               AS saved_best_step FROM nb)
SELECT sw.run, moe_num_experts, coalesce(moe_router_jitter, 0.0e0) AS moe_router_jitter, moe_capacity_factor,
       steps, 512 AS d_model, 200 AS eval_every, final_val_ppl, best_val_ppl, saved_best_step
FROM sw LEFT JOIN summ USING (run) LEFT JOIN nbs USING (run)
"""

SQL["mixed_logs"] = "WITH " + GRID_LOG + """,
csv AS (SELECT run, step, round(train_loss, 6) AS train_loss, round(val_ppl, 6) AS val_ppl,
               CASE WHEN starts_with(run, 'all_moe_e') THEN 'nan'::DOUBLE ELSE round(tokens_per_sec, 2) END
                 AS tokens_per_sec,
               CASE WHEN starts_with(run, 'all_moe_e') THEN 'nan'::DOUBLE ELSE round(gpu_mem_mb, 1) END
                 AS gpu_mem_mb
        FROM gf),
""" + _summary("csv") + """
SELECT run, final_val_ppl, best_val_ppl, best_step, last_train_loss, max_tok_s, peak_mem_mb FROM summ2
"""

FOLD = RUN_LOG + """,
evs AS (SELECT run, step, ts, val_ppl AS v,
              row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM run_log),
fold AS (
  SELECT run, i, step, (v + 0.1e0 < 'inf'::DOUBLE) AS improved,
         CASE WHEN v + 0.1e0 < 'inf'::DOUBLE THEN v ELSE 'inf'::DOUBLE END AS best_val,
         CAST(CASE WHEN v + 0.1e0 < 'inf'::DOUBLE THEN step ELSE -1 END AS BIGINT) AS best_step,
         CAST(CASE WHEN v + 0.1e0 < 'inf'::DOUBLE THEN 0 ELSE 1 END AS BIGINT) AS no_improve
  FROM evs WHERE i = 1
  UNION ALL
  SELECT e.run, e.i, e.step, (e.v + 0.1e0 < f.best_val),
         CASE WHEN e.v + 0.1e0 < f.best_val THEN e.v ELSE f.best_val END,
         CASE WHEN e.v + 0.1e0 < f.best_val THEN e.step ELSE f.best_step END,
         CASE WHEN e.v + 0.1e0 < f.best_val THEN 0 ELSE f.no_improve + 1 END
  FROM fold f JOIN evs e ON e.run = f.run AND e.i = f.i + 1),
stops AS (
  SELECT run, min(step) FILTER (WHERE NOT improved AND step >= 20 AND no_improve >= 5) AS stop_step,
         max(step) AS last_step FROM fold GROUP BY run),
es AS (
  SELECT s.run, s.stop_step, f.best_val, f.best_step
  FROM stops s JOIN fold f ON f.run = s.run AND f.step = coalesce(s.stop_step, s.last_step)),
t0 AS (SELECT run, min(epoch_us(ts)) AS t0 FROM run_log GROUP BY run),
tstop AS (
  SELECT r.run, min(r.step) FILTER (WHERE r.step % 5 = 0
                                     AND (epoch_us(r.ts) - t0.t0) / 1e6 / 60e0 >= 30000)
           AS time_stop_step
  FROM run_log r JOIN t0 USING (run) GROUP BY r.run),
ends AS (
  SELECT s.run, least(coalesce(s.stop_step, 60), coalesce(t.time_stop_step, 60), 60, s.last_step)
           AS end_step
  FROM stops s JOIN tstop t USING (run))"""

SQL["track_best"] = "WITH RECURSIVE " + FOLD + """
SELECT run, step, improved, best_val, best_step, no_improve FROM fold
"""

SQL["early_stop"] = "WITH RECURSIVE " + FOLD + """
SELECT run, stop_step, best_val, best_step FROM es
"""

SQL["time_stop"] = "WITH RECURSIVE " + FOLD + """
SELECT run, time_stop_step FROM tstop
"""

SQL["truncate_runs"] = "WITH RECURSIVE " + FOLD + """
SELECT r.run, r.step, r.val_ppl FROM run_log r JOIN ends USING (run) WHERE r.step <= ends.end_step
"""

SQL["pick_snapshot"] = "WITH RECURSIVE " + FOLD + """
SELECT e.run, max(f.step) FILTER (WHERE f.improved) AS best_step, e.end_step AS last_step,
       coalesce(max(f.step) FILTER (WHERE f.improved), e.end_step) AS snapshot_step,
       e.end_step AS meta_step, CAST(floor(e.end_step / 10) AS BIGINT) AS n_saves
FROM ends e JOIN fold f ON f.run = e.run AND f.step <= e.end_step
GROUP BY e.run, e.end_step
"""

ROUTE = """vectors AS (SELECT vec_id, vec_id // 100 AS batch, CAST(embedding AS DOUBLE[]) AS vec, label
            FROM embeddings),
rtr AS (SELECT label AS expert, i, round(avg(CAST(x AS DOUBLE)), 6) AS w
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
              FROM embeddings) GROUP BY label, i),
rw AS (SELECT expert, list(w ORDER BY i) AS w FROM rtr GROUP BY expert),
ne AS (SELECT count(*) AS e FROM rw),
lg0 AS (SELECT v.vec_id, v.batch, v.label, r.expert, list_dot_product(v.vec, r.w) AS logit
        FROM vectors v CROSS JOIN rw r),
lg AS (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS mx FROM lg0),
pr AS (SELECT *, exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY vec_id) AS p,
              mx + ln(sum(exp(logit - mx)) OVER (PARTITION BY vec_id)) AS lse FROM lg),
top AS (SELECT vec_id, batch, label, expert AS top1, p AS top1_prob FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS rk FROM pr)
        WHERE rk = 1),
stats AS (SELECT pr.batch, pr.expert, avg(pr.p) AS importance,
                 avg(CASE WHEN t.top1 = pr.expert THEN 1.0e0 ELSE 0.0e0 END) AS load
          FROM pr JOIN top t USING (vec_id) GROUP BY pr.batch, pr.expert),
aux AS (SELECT batch, (SELECT e FROM ne) * sum(importance * load) AS aux FROM stats GROUP BY batch),
ce AS (SELECT vec_id, batch, lse - logit AS ce FROM pr WHERE expert = label),
capped AS (SELECT t.*, row_number() OVER (PARTITION BY batch, top1 ORDER BY vec_id)
                   <= ceil(1.0e0 * count(*) OVER (PARTITION BY batch) / (SELECT e FROM ne)) AS kept
           FROM top t)"""

SQL["route_top1"] = "WITH " + ROUTE + """
SELECT vec_id, batch, CAST(top1 AS INTEGER) AS top1, round(top1_prob, 6) AS top1_prob FROM top
"""

SQL["router_stats"] = "WITH " + ROUTE + """
SELECT batch, CAST(expert AS INTEGER) AS expert, round(importance, 6) AS importance,
       round(load, 6) AS load FROM stats
"""

SQL["aux_loss"] = "WITH " + ROUTE + "\nSELECT batch, round(aux, 6) AS aux FROM aux"

SQL["total_loss"] = "WITH " + ROUTE + """,
cb AS (SELECT batch, avg(ce) AS ce FROM ce GROUP BY batch)
SELECT batch, round(ce, 6) AS ce, round(aux, 6) AS aux, round(ce + 0.01e0 * aux, 6) AS total
FROM cb JOIN aux USING (batch)
"""

JITTERED = ROUTE.split(",\nlg AS")[0] + """,
hu AS (SELECT *, (CAST(('0x' || substr(md5('42:' || vec_id || ':' || expert || ':a'), 1, 8)) AS BIGINT)
                  + 0.5e0) / 4294967296e0 AS u1,
                 (CAST(('0x' || substr(md5('42:' || vec_id || ':' || expert || ':b'), 1, 8)) AS BIGINT)
                  + 0.5e0) / 4294967296e0 AS u2 FROM lg0),
jl AS (SELECT vec_id, batch, expert,
              logit + 0.05e0 * (sqrt(-2e0 * ln(u1)) * cos(2 * pi() * u2)) AS logit FROM hu),
jm AS (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS mx FROM jl),
jp AS (SELECT *, exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY vec_id) AS p FROM jm)"""

SQL["router_jitter"] = "WITH " + JITTERED + """
SELECT vec_id, batch, CAST(expert AS INTEGER) AS top1, round(p, 6) AS top1_prob FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS rk FROM jp)
WHERE rk = 1
"""

SQL["capacity_dispatch"] = "WITH " + ROUTE + """
SELECT vec_id, batch, CAST(top1 AS INTEGER) AS expert, kept FROM capped
"""

SQL["dispatch_report"] = "WITH " + ROUTE + """
SELECT CASE grouping(batch, top1) WHEN 0 THEN 'batch_expert' WHEN 2 THEN 'expert' ELSE 'all' END
         AS level,
       coalesce(batch, -1) AS batch, CAST(coalesce(top1, -1) AS INTEGER) AS expert,
       count(*) AS routed,
       CAST(sum(CAST(kept AS INTEGER)) AS BIGINT) AS kept,
       CAST(count(*) - sum(CAST(kept AS INTEGER)) AS BIGINT) AS dropped,
       round((count(*) - sum(CAST(kept AS INTEGER))) / count(*), 6) AS drop_rate
FROM capped GROUP BY GROUPING SETS ((batch, top1), (top1), ())
"""

SQL["layer_norm"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT vec_id, x, list_sum(x) / len(x) AS m FROM v),
s2 AS (SELECT vec_id, x, m, list_sum(list_transform(x, lambda a: (a - m) * (a - m))) / len(x) AS var FROM s),
y AS (SELECT vec_id, list_transform(x, lambda a: (a - m) / sqrt(var + 1e-5)) AS y FROM s2)
SELECT vec_id, round(list_min(y), 6) AS y_min, round(list_max(y), 6) AS y_max,
       round(list_sum(list_transform(y, lambda a: abs(a))), 6) AS y_l1 FROM y
"""

SQL["embed_tokens"] = "WITH " + VOCAB + """,
ve AS (SELECT tok, id FROM v UNION ALL SELECT '<eos>', (SELECT count(*) FROM v)),
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
t AS (SELECT p.split, p.doc_id, p.p AS gpos, ve.id % (SELECT count(*) FROM embeddings) AS emb_id,
             p.p % 64 AS pos
      FROM pos p JOIN ve USING (tok))
SELECT t.split, t.doc_id, t.gpos, t.emb_id, t.pos,
       round(list_sum(list_transform(list_zip(e.vec, q.vec), lambda z: z[1] + z[2])), 6) AS emb_sum
FROM t JOIN emb e ON e.vec_id = t.emb_id JOIN emb q ON q.vec_id = t.pos
"""

def _hash_w(name: str, idx: str, bound: str) -> str:
    """Expert weight entry by the hash rule of expert_weights."""
    return (f"(2 * CAST(('0x' || substr(md5('42:{name}:' || ex.expert || ':' || {idx}), 1, 8))"
            f" AS BIGINT) / 4294967296e0 - 1) * {bound}")


# Expert feed-forward w2 . silu(w1 . x + b1) + b2 (d_model 64, d_ff 256),
# gated by the top-1 probability, for the kept rows; weights rebuilt here.
EXPERT_FFN = ROUTE + f""",
kx AS (SELECT c.vec_id, c.top1 AS expert, c.top1_prob AS g, v.vec
       FROM capped c JOIN vectors v USING (vec_id) WHERE c.kept),
xi AS (SELECT vec_id, expert, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM kx),
ex AS (SELECT DISTINCT expert FROM kx),
w1 AS (SELECT ex.expert, a.i, b.j, {_hash_w("w1", "a.i || ':' || b.j", "(1 / sqrt(64))")} AS w
       FROM ex CROSS JOIN range(64) AS a(i) CROSS JOIN range(256) AS b(j)),
b1 AS (SELECT ex.expert, b.j, {_hash_w("b1", "b.j", "(1 / sqrt(64))")} AS w
       FROM ex CROSS JOIN range(256) AS b(j)),
w2 AS (SELECT ex.expert, b.j, a.k, {_hash_w("w2", "b.j || ':' || a.k", "(1 / sqrt(256))")} AS w
       FROM ex CROSS JOIN range(256) AS b(j) CROSS JOIN range(64) AS a(k)),
b2 AS (SELECT ex.expert, a.k, {_hash_w("b2", "a.k", "(1 / sqrt(256))")} AS w
       FROM ex CROSS JOIN range(64) AS a(k)),
h AS (SELECT xi.vec_id, xi.expert, w1.j, sum(xi.x * w1.w) AS z
      FROM xi JOIN w1 ON w1.expert = xi.expert AND w1.i = xi.i GROUP BY xi.vec_id, xi.expert, w1.j),
hs AS (SELECT h.vec_id, h.expert, h.j, (h.z + b1.w) / (1 + exp(-(h.z + b1.w))) AS s
       FROM h JOIN b1 ON b1.expert = h.expert AND b1.j = h.j),
yo AS (SELECT hs.vec_id, hs.expert, w2.k, sum(hs.s * w2.w) AS z
       FROM hs JOIN w2 ON w2.expert = hs.expert AND w2.j = hs.j GROUP BY hs.vec_id, hs.expert, w2.k),
yg AS (SELECT yo.vec_id, yo.expert, yo.k, (yo.z + b2.w) * kx.g AS y
       FROM yo JOIN b2 ON b2.expert = yo.expert AND b2.k = yo.k JOIN kx ON kx.vec_id = yo.vec_id)"""

SQL["expert_scores"] = "WITH " + EXPERT_FFN + """
SELECT vec_id, CAST(expert AS INTEGER) AS expert, round(sum(y), 6) AS y_sum,
       md5(string_agg(CAST(CAST(round(y * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY k)) AS y_md5
FROM yg GROUP BY vec_id, expert
"""

SQL["moe_combine"] = "WITH " + EXPERT_FFN + """,
xa AS (SELECT vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM vectors)
SELECT c.vec_id, c.kept, round(sum(xa.x + coalesce(yg.y, 0)), 6) AS out_sum,
       md5(string_agg(CAST(CAST(round((xa.x + coalesce(yg.y, 0)) * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY xa.i))
         AS out_md5
FROM capped c JOIN xa USING (vec_id) LEFT JOIN yg ON yg.vec_id = xa.vec_id AND yg.k = xa.i
GROUP BY c.vec_id, c.kept
"""


SQL["token_ce"] = "WITH " + ROUTE + "\nSELECT vec_id, batch, round(ce, 6) AS ce FROM ce"

SQL["eval_loss"] = "WITH " + ROUTE + """,
pb AS (SELECT batch, avg(ce) AS m, count(*) AS n FROM ce GROUP BY batch),
fb AS (SELECT * FROM pb WHERE n = 100 AND batch < 50),
agg AS (SELECT avg(m) AS l, count(*) AS nb FROM fb)
SELECT round(coalesce(l, 'nan'::DOUBLE), 6) AS val_loss,
       round(CASE WHEN nb = 0 THEN 'nan'::DOUBLE
                  WHEN isfinite(l) AND l < 20 THEN exp(l) ELSE 'inf'::DOUBLE END, 3) AS val_ppl,
       nb AS n_batches FROM agg
"""

PAIRS = CORPUS + """,
wt AS (SELECT doc_id, split, lang, source, regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+') AS t
       FROM corpus),
wf AS (SELECT doc_id, split, lang, source, generate_subscripts(t, 1) AS i, unnest(t) AS tok FROM wt),
pairs AS (SELECT * FROM (SELECT doc_id, split, lang, source, tok,
                                lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM wf)
          WHERE nxt IS NOT NULL),
bg AS (SELECT tok, nxt, count(*) AS count FROM pairs WHERE split = 'train' GROUP BY tok, nxt),
uni AS (SELECT tok, sum(count) AS ct FROM bg GROUP BY tok),
nv AS (SELECT count(DISTINCT tok) AS nv FROM wf),
nll AS (SELECT p.doc_id, p.lang, p.source,
               -ln((coalesce(b.count, 0) + 1.0e0) / (coalesce(u.ct, 0) + 1.0e0 * (SELECT nv FROM nv))) AS nll
        FROM pairs p LEFT JOIN bg b ON b.tok = p.tok AND b.nxt = p.nxt
        LEFT JOIN uni u ON u.tok = p.tok WHERE p.split = 'validation')"""

SQL["bigram_fit"] = "WITH " + PAIRS + "\nSELECT tok, nxt, count FROM bg"

PPL = "CASE WHEN isfinite(avg(nll)) AND avg(nll) < 20 THEN exp(avg(nll)) ELSE 'inf'::DOUBLE END"

SQL["heldout_ppl"] = "WITH " + PAIRS + f"""
SELECT doc_id, count(*) AS n_pairs, round(avg(nll), 6) AS loss, round({PPL}, 3) AS ppl
FROM nll GROUP BY doc_id
"""

SQL["heldout_slices"] = "WITH " + PAIRS + f"""
SELECT lang, source, count(*) AS n_pairs, round(avg(nll), 6) AS loss, round({PPL}, 3) AS ppl
FROM nll GROUP BY GROUPING SETS ((lang), (source), ())
"""

SQL["temperature_draw"] = "WITH " + ROUTE.split(",\nlg AS")[0] + """,
tl AS (SELECT vec_id, expert, logit / 0.8e0 AS l FROM lg0),
tm AS (SELECT *, max(l) OVER (PARTITION BY vec_id) AS mx FROM tl),
tp AS (SELECT *, exp(l - mx) / sum(exp(l - mx)) OVER (PARTITION BY vec_id) AS p FROM tm),
tc AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY expert
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              CAST(('0x' || substr(md5('42:' || vec_id), 1, 8)) AS BIGINT) / 4294967296e0 AS u
       FROM tp),
pick AS (SELECT vec_id, coalesce(min(expert) FILTER (WHERE cum > u), max(expert)) AS d
         FROM tc GROUP BY vec_id)
SELECT k.vec_id, CAST(k.d AS INTEGER) AS draw, round(tp.p, 6) AS p_draw
FROM pick k JOIN tp ON tp.vec_id = k.vec_id AND tp.expert = k.d
"""

# The streaming monitor must agree with the batch fold on the runs that stop.
SQL["live_early_stop"] = "WITH RECURSIVE " + FOLD + """
SELECT run, stop_step, best_val, best_step FROM es WHERE stop_step IS NOT NULL
"""

SQL["capped_eval_loss"] = SQL["eval_loss"].replace("batch < 50", "batch < 3")

SQL["scaled_layer_norm"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT vec_id, x, list_sum(x) / len(x) AS m FROM v),
s2 AS (SELECT vec_id, x, m, list_sum(list_transform(x, lambda a: (a - m) * (a - m))) / len(x) AS var FROM s),
y AS (SELECT vec_id, list_transform(x, lambda a, i: (a - m) / sqrt(var + 1e-5) * (1 + (i - 1) / 64e0)
                                                    + (i - 1) / 100e0) AS y FROM s2)
SELECT vec_id, md5(array_to_string(list_transform(y, lambda a: CAST(round(a * 1e6) AS BIGINT)), ',')) AS y_md5 FROM y
"""

SQL["recent_tokens"] = "WITH " + TOKENS + """
SELECT doc_id, least(len(t), 40) AS n_last,
       md5(array_to_string(t[greatest(1, len(t) - 39):], ' ')) AS last_md5 FROM toks
"""

SQL["layered_loss"] = "WITH " + ROUTE + """,
""" + JITTERED.split(ROUTE.split(",\nlg AS")[0] + ",\n")[1] + """,
jt AS (SELECT vec_id, expert AS top1 FROM (
         SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS rk FROM jp) WHERE rk = 1),
js AS (SELECT jp.batch, jp.expert, avg(jp.p) AS importance,
              avg(CASE WHEN jt.top1 = jp.expert THEN 1.0e0 ELSE 0.0e0 END) AS load
       FROM jp JOIN jt USING (vec_id) GROUP BY jp.batch, jp.expert),
layers AS (SELECT batch, aux FROM aux UNION ALL
           SELECT batch, (SELECT e FROM ne) * sum(importance * load) FROM js GROUP BY batch),
ab AS (SELECT batch, sum(aux) AS aux FROM layers GROUP BY batch),
cb AS (SELECT batch, avg(ce) AS ce FROM ce GROUP BY batch)
SELECT batch, round(ce, 6) AS ce, round(aux, 6) AS aux, round(ce + 0.01e0 * aux, 6) AS total
FROM cb JOIN ab USING (batch)
"""

SQL["live_run_end"] = "WITH RECURSIVE " + FOLD + """
SELECT run, end_step FROM ends
"""

SQL["streamed_logs"] = SQL["mixed_logs"]

SQL["run_throughput"] = "WITH " + RUN_LOG + """,
t0 AS (SELECT run, min(epoch_us(ts)) AS t0 FROM run_log GROUP BY run),
e AS (SELECT r.*, (epoch_us(r.ts) - t0.t0) / 1e6 AS el FROM run_log r JOIN t0 USING (run))
SELECT run, step, round(el, 6) AS elapsed,
       round(CAST(step * 16 * 256 AS DOUBLE) / greatest(1e-6, el), 4) AS tok_per_sec,
       coalesce(CASE WHEN NOT isnan(gpu_mem_mb) THEN gpu_mem_mb * 1000e0 END / 1048576e0, 0e0)
         AS mem_mb
FROM e
"""

# The sweep logs as written to CSV (6/6/6/6/2/1 decimals), then summarised.
SQL["study_summary"] = "WITH " + GRID_LOG + """,
csv AS (SELECT run, step, round(train_loss, 6) AS train_loss, round(val_ppl, 6) AS val_ppl,
               round(tokens_per_sec, 2) AS tokens_per_sec, round(gpu_mem_mb, 1) AS gpu_mem_mb
        FROM gf),
""" + _summary("csv") + """,
base AS (SELECT arg_max(final_val_ppl, run) AS bp FROM summ WHERE run LIKE '%baseline%')
SELECT run, final_val_ppl, best_val_ppl, best_step, last_train_loss, max_tok_s, peak_mem_mb,
       round(CASE WHEN isfinite(bp) THEN (bp - final_val_ppl) / bp * 100e0 END, 6)
         AS ppl_improve_vs_base_pct
FROM summ2, base
"""
