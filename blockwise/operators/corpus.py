"""Corpus preparation: tokenise, vocabulary, encode/decode, global token
offsets, fixed-length shifted blocks, head cap and size report.

The token stream of a split is never materialised as one array: each
document keeps its own token array plus its global ``start`` offset, and
blocks are assembled from the documents that overlap them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from blockwise.operators.prefix import SUM, ordered_scan, ranged_rank
from blockwise.session import cut

# The word encoder's token pattern (maximal runs of anything
# but space, tab, CR, LF) and its end-of-document marker.
WORD_CHAR = r"[^ \t\r\n]"
WORD_PATTERN = WORD_CHAR + "+"
EOS_TOKEN = "<eos>"



def tokenize_words(df: DataFrame, text_col: str = "text", out: str = "toks",
                   eos: str | None = EOS_TOKEN, count_col: str | None = "n") -> DataFrame:
    """Word encoder (B1): whitespace-split tokens; with ``eos`` one end
    marker is appended after every document, empty ones included (B5).
    ``count_col`` also gets the token count from a counting regex over the
    same pattern, so passes that need only counts (offsets, totals) never
    build the token arrays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    toks = F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0)
    n = F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")
    if eos is not None:
        toks = F.concat(toks, F.array(F.lit(eos)))
        n = n + 1
    out_df = df.withColumn(out, toks)
    return out_df.withColumn(count_col, n) if count_col else out_df


def check_special(df: DataFrame, markers: Sequence[str], text_col: str = "text",
                  mode: str = "error", whole: bool = False) -> DataFrame:
    """Guard against texts holding an encoder's own special marker (B6).
    With ``whole`` only a marker that is a word of its own counts, which is
    what the word encoder would take for an appended one.

    ``error``: the returned frame fails at run time on the first such row
    (no extra job); ``drop``: such rows are removed; ``count``: one row with
    the number of offending documents per marker.
    """
    def has(m):
        found = F.col(text_col).contains(m)
        return found & F.col(text_col).rlike(rf"(?<!{WORD_CHAR}){re.escape(m)}(?!{WORD_CHAR})") if whole else found

    hit = F.lit(False)
    for m in markers:
        hit = hit | has(m)
    if mode == "error":
        return df.filter(F.when(hit, F.raise_error(
            F.lit("text contains an end-of-text marker of the encoder"))).otherwise(F.lit(True)))
    if mode == "drop":
        return df.filter(~hit)
    if mode == "count":
        return df.agg(*[F.count(F.when(has(m), 1)).alias(f"n_{i}")
                        for i, m in enumerate(markers)])
    raise ValueError(f"unknown mode {mode!r}")


def build_vocab(tokens: DataFrame, tok_col: str = "toks", min_count: int = 1,
                exclude: Sequence[str] = (EOS_TOKEN,)) -> DataFrame:
    """Vocabulary (B2): (tok, count, id), ids dense from 0 by count desc,
    then token ascending (byte order). Counting uses partial aggregation;
    ids are ranks over ranges of that order."""
    t = tokens.select(F.explode(tok_col).alias("tok"))
    if exclude:
        t = t.filter(~F.col("tok").isin(list(exclude)))
    counts = t.groupBy("tok").agg(F.count(F.lit(1)).alias("count"))
    if min_count > 1:
        counts = counts.filter(F.col("count") >= min_count)
    counts = cut(counts)                  # read twice by the rank; one row per type
    ranked = ranged_rank(counts, [F.col("count").desc(), F.col("tok").asc()], out="id")
    return ranked.select("tok", "count", "id")


def with_eos(vocab: DataFrame) -> DataFrame:
    """(tok, id) of the vocabulary and the end marker, whose id is the
    vocabulary's size (B4)."""
    v = vocab.select("tok", "id")
    return v.unionByName(v.agg(F.count(F.lit(1)).alias("id")).select(F.lit(EOS_TOKEN).alias("tok"), "id"))


HOT_TOKENS = 1 << 16      # most frequent vocabulary rows joined by broadcast


def _hot_cold_join(rows: DataFrame, vocab: DataFrame, key: str, hot: int,
                   always_hot: Sequence[str]) -> DataFrame:
    """Left join of token rows to the vocabulary on ``key`` ('tok' or
    'id') that is safe for hot keys: ids are frequency ranks, so the rows
    with id < ``hot`` (plus ``always_hot`` tokens such as the end marker)
    are the heavy hitters. They are broadcast (at most hot + len(always_hot)
    rows); the remaining rows, none of which can be hot, go through a
    shuffle join."""
    other = "id" if key == "tok" else "tok"
    v = vocab.select("tok", "id")
    is_hot = F.col("id") < F.lit(hot)
    if always_hot:
        is_hot = is_hot | F.col("tok").isin(list(always_hot))
    hot_v = v.filter(is_hot)
    cold_v = v.filter(~is_hot)
    j = rows.join(F.broadcast(hot_v.withColumnRenamed(other, "_h")), key, "left")
    done = j.filter(F.col("_h").isNotNull()).withColumnRenamed("_h", other)
    rest = j.filter(F.col("_h").isNull()).drop("_h").join(cold_v, key, "left")
    return done.unionByName(rest)


def encode_ids(tokens: DataFrame, vocab: DataFrame, key: str = "doc_id", tok_col: str = "toks",
               out: str = "ids", unknown: int = -1, hot: int = HOT_TOKENS,
               always_hot: Sequence[str] = (EOS_TOKEN,)) -> DataFrame:
    """Map each document's token array to ids through an equi-join with the
    vocabulary (B3); hot tokens are broadcast (see ``_hot_cold_join``),
    then each document's ids are regrouped in position order."""
    ex = tokens.select(key, F.posexplode(tok_col).alias("pos", "tok"))
    j = _hot_cold_join(ex, vocab, "tok", hot, always_hot)
    g = j.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        "pos", F.coalesce(F.col("id"), F.lit(unknown)).alias("id")))).alias("_p"))
    return g.select(key, F.transform("_p", lambda s: s["id"]).alias(out))


def decode_ids(ids: DataFrame, vocab: DataFrame, key: str = "doc_id", ids_col: str = "ids",
               out: str = "toks", hot: int = HOT_TOKENS,
               always_hot: Sequence[str] = (EOS_TOKEN,)) -> DataFrame:
    """Map id arrays back to token arrays (hot/cold join on id, regroup)."""
    ex = ids.select(key, F.posexplode(ids_col).alias("pos", "id"))
    j = _hot_cold_join(ex, vocab, "id", hot, always_hot)
    g = j.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("_p"))
    return g.select(key, F.transform("_p", lambda s: s["tok"]).alias(out))


def head_docs(df: DataFrame, n: int | None, order_col: str = "doc_id",
              partition_cols: Sequence[str] = ()) -> DataFrame:
    """First ``min(n, count)`` documents in source order (A2); ``None`` keeps
    all. The rank comes from sampled ranges of the order, so no
    single-partition limit is planned and ids may be as sparse as they like."""
    if n is None:
        return df.withColumn("doc_rank", F.lit(None).cast("long"))
    ranked = ranged_rank(df, [order_col], partition_cols, out="doc_rank")
    return ranked.filter(F.col("doc_rank") < F.lit(n))


def validation_cap(max_samples: int | None) -> int:
    """Validation document cap (A3): 20000, or min(20000, max_samples)."""
    return 20_000 if max_samples is None else min(20_000, max_samples)


def token_offsets(df: DataFrame, tok_col: str = "toks", order_col: str = "doc_id",
                  partition_cols: Sequence[str] = ("split",)) -> DataFrame:
    """Add ``start`` (global offset of the document's first token in its
    split's stream, a running sum over sampled ranges, C1) and ``total``
    (tokens in the split, from the ranges' sums). Uses the ``n`` column when
    present (see :func:`tokenize_words`), else ``size(tok_col)``."""
    d = df if "n" in df.columns else df.withColumn("n", F.size(tok_col).cast("long"))
    d = ordered_scan(d, [order_col], {"start": (SUM, F.col("n"))}, partition_cols, inclusive=False,
                     whole={"total": "start"})
    return d.withColumns({"start": F.coalesce("start", F.lit(0)).cast("long"), "total": F.col("total").cast("long")})


START_BLOCK = 256                # rows of a file whose starts stand in one row
MAX_STARTS_BYTES = 64 << 20      # starts up to this are broadcast


def put_starts(docs: DataFrame, offsets: DataFrame, max_broadcast_bytes: int = MAX_STARTS_BYTES) -> DataFrame:
    """``docs`` with the ``start`` that ``offsets`` (file, row, start; see
    :func:`token_offsets`) gives their place (file, row), so the texts need
    not be put in order to get it. A row's start takes 12 bytes: the starts of
    ``START_BLOCK`` rows of a file stand in two arrays. Up to
    ``max_broadcast_bytes`` they are broadcast and the texts stay where they
    are; beyond it both are shuffled once. A row without a start goes."""
    block = F.floor(F.col("row") / START_BLOCK).alias("_block")
    at = (F.col("row") % START_BLOCK).cast("int")
    packed = offsets.groupBy("file", block).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "start"))).alias("s"))
    packed = cut(packed.select("file", "_block", F.col("s.at").alias("_at"), F.col("s.start").alias("_start")))
    few = (packed.agg(F.sum(F.size("_at"))).first()[0] or 0) * 12 <= max_broadcast_bytes
    j = docs.withColumn("_block", block).join(F.broadcast(packed) if few else packed.hint("merge"), ["file", "_block"])
    start = F.get("_start", F.array_position("_at", at).cast("int") - 1)
    return j.withColumn("start", start).filter("start is not null").drop("_block", "_at", "_start")


def n_blocks(n_tokens, seq_len: int):
    """Block count ``N div L - 1`` (C4): the remainder and one more full
    block are dropped. Works on ints and Columns; negative means none."""
    if isinstance(n_tokens, int):
        return n_tokens // seq_len - 1
    return (n_tokens / F.lit(seq_len)).cast("long") - 1


def pack_blocks(docs: DataFrame, seq_len: int, tok_col: str = "toks",
                partition_cols: Sequence[str] = ("split",)) -> DataFrame:
    """Fixed-length shifted blocks (C2, C3, C4) from documents carrying
    ``start``, ``n`` and ``total`` (see :func:`token_offsets`).

    Block b holds stream positions [bL, bL+L]: x = first L, y = last L.
    Blocks lying inside one document are cut in place (no shuffle); only
    blocks that straddle document edges are gathered with a group by block,
    whose size is bounded by L+1 tokens. Output: (*partition_cols,
    block_id, x, y).
    """
    L = int(seq_len)
    part = list(partition_cols)
    d = docs.withColumn("_nb", n_blocks(F.col("total"), L))
    start, n = F.col("start"), F.col("n")
    lo_b = F.greatest(F.lit(0), ((start - 1) / F.lit(L)).cast("long"))
    lo_b = F.when(start == 0, F.lit(0)).otherwise(lo_b)
    hi_b = F.least(((start + n - 1) / F.lit(L)).cast("long"), F.col("_nb") - 1)
    d = d.filter((n > 0) & (hi_b >= lo_b)).withColumn(
        "block_id", F.explode(F.sequence(lo_b, hi_b)))
    b0 = F.col("block_id") * F.lit(L)
    lo = F.greatest(start, b0)
    hi = F.least(start + n - 1, b0 + L)
    d = d.withColumn("_lo", lo).withColumn(
        "_seg", F.slice(tok_col, (F.col("_lo") - start + 1).cast("int"),
                        (hi - F.col("_lo") + 1).cast("int")))
    inside = (start <= b0) & (b0 + L <= start + n - 1)
    whole = d.filter(inside).select(*part, "block_id", F.col("_seg").alias("_w"))
    edge = (d.filter(~inside)
             .groupBy(*part, "block_id")
             .agg(F.array_sort(F.collect_list(F.struct("_lo", "_seg"))).alias("_parts"))
             .select(*part, "block_id",
                     F.flatten(F.transform("_parts", lambda s: s["_seg"])).alias("_w")))
    w = whole.unionByName(edge)
    return w.select(*part, "block_id", F.slice("_w", 1, L).alias("x"),
                    F.slice("_w", 2, L).alias("y"))


def corpus_report(docs: DataFrame, seq_len: int, batch_size: int,
                  partition_cols: Sequence[str] = ("split",)) -> DataFrame:
    """Per split: documents, tokens (with end markers), blocks and batches
    (F8). ``docs`` carries ``n``; one aggregation with partial combine."""
    L, B = int(seq_len), int(batch_size)
    g = docs.groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("n_docs"),
                                          F.sum("n").cast("long").alias("n_tokens"))
    nb = F.greatest(n_blocks(F.col("n_tokens"), L), F.lit(0))
    return g.withColumn("n_blocks", nb).withColumn(
        "n_batches", (F.col("n_blocks") / F.lit(B)).cast("long"))
