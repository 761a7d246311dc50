"""Benchmark decontamination by a distributed positional inverted index.

1. The training corpus is counted over the test vocabulary; every window of
   ``window`` consecutive test words gets its rarest and second rarest word.
2. The corpus is indexed: one posting (term, document, position) for every
   test word that stands less than ``window`` words from a rarest word (a
   whole window always does), written to the shared folder.
3. Postings of the rarest words, moved back by the word's offset in the
   item, give candidate diagonals; the moved list of the second rarest word
   is intersected with them on (document, position).
4. What is left is intersected with the lists of all other words of the
   item on the same diagonal; runs of at least ``window`` matched words are
   exact phrase matches. Items whose ``near_terms`` rarest indexed words
   stand within ``near_span`` words of each other are proximity matches.

The vocabulary is looked up in tasks, so it is bounded: items are dealt by
hash into blocks of about ``block_words`` words, and each block passes over
the corpus by itself. A block of at most twice that many words (counted) is
also broadcast to the postings, so a frequent term or item is not gathered in
one task; a larger one (a single huge item) is shuffled. Everything else is
an equi-join.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from blockwise.llm.common import cut, identity, utf8

WINDOW = 13
BLOCK_WORDS = 1_000_000
NEAR_TERMS = 3
NEAR_SPAN = 26
# 20 * n_hit >= n_words: one word in twenty
HIT_SHARE = 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]")
_BLANK = bytes(c if _WORD.match(bytes([c])) else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII digits, letters (A-Z in lower case) and any non-ASCII
    characters; everything else separates."""
    return text.lower().translate(_BLANK).split()


def _item_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, n, ipos, word): one row per word of each distinct item."""
    d = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.coalesce(text, F.lit("")).alias("t")).distinct()
    words = F.regexp_extract_all(F.translate("t", string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))
    d = d.select("item_id", F.xxhash64(F.col("item_id").isNull(), "item_id", "t").alias("item"),
                 F.transform(words, lambda w: w.cast("binary")).alias("w"))
    return d.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "word"))


def _counts(docs: DataFrame, vocab) -> DataFrame:
    def count(batches):
        get, miss = vocab.value.get, len(vocab.value)
        total = np.zeros(miss + 1, np.int64)
        for batch in batches:
            for b in batch.column(0):
                ids = np.array([get(w, miss) for w in words_of(b.as_py())], np.int64)
                total += np.bincount(ids, minlength=miss + 1)
        found = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])],
                                         ["term", "n"])

    return (docs.select("b").mapInArrow(count, "term int, n long")
            .groupBy("term").agg(F.sum("n").alias("df")))


def _postings(docs: DataFrame, vocab, seeds: np.ndarray, window: int) -> DataFrame:
    """(doc_id, doc, term, pos): the index of (doc_id, doc, b). Each row of the corpus also has a
    row with term -1 whose pos is its number of words."""
    def index(batches):
        get, miss = vocab.value.get, len(vocab.value)
        is_seed = np.zeros(miss + 1, bool)
        is_seed[seeds] = True
        for batch in batches:
            at, term, pos = [], [], []
            for i, b in enumerate(batch.column(2)):
                ids = np.array([get(w, miss) for w in words_of(b.as_py())], np.int64)
                keep = hit = np.flatnonzero(is_seed[ids])
                if len(hit):
                    near = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(near, np.maximum(hit - window + 1, 0), 1)
                    np.add.at(near, np.minimum(hit + window, len(ids)), -1)
                    keep = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (ids < miss))
                at.append(np.full(len(keep) + 1, i))
                term += [np.array([-1]), ids[keep]]
                pos += [np.array([len(ids)]), keep]
            if at:
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at),
                     pa.array(np.concatenate(term), pa.int32()), pa.array(np.concatenate(pos), pa.int64())],
                    ["doc_id", "doc", "term", "pos"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "doc", "b").mapInArrow(index, f"doc_id {kind}, doc binary, term int, pos long")


def documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, doc_id, b): the rows of the corpus; doc names id and text."""
    return docs.select(identity(id_col, text).alias("doc"), F.col(id_col).alias("doc_id"), utf8(text).alias("b"))


def find_matches(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                 window: int = WINDOW, block_words: int = BLOCK_WORDS, near_terms: int = NEAR_TERMS,
                 near_span: int = NEAR_SPAN) -> tuple:
    """(rows, phrases, near) of what :func:`documents` gives. rows: (doc_id,
    doc, n_words) for every row of the corpus. phrases: (doc, item_id, diag,
    start, stop), an exact run of test words at document positions
    start..stop (both included). near: (doc, item_id, pos), a proximity match
    ending at pos. Null texts have no words; items without words match
    nothing; repeated items count once."""
    items = cut(_item_words(benchmark, item_id, text))
    total = items.count()
    blocks = max(1, -(-total // block_words))
    rows = phrases = near = None
    for k in range(blocks):
        own = items.filter(F.pmod("item", F.lit(blocks)) == k)
        small = blocks == 1 or own.count() <= 2 * block_words
        r, p, m = _match_block(docs, own, window, near_terms, near_span,
                               F.broadcast if small else lambda d: d)
        rows = r if rows is None else rows          # the same for every block
        phrases = p if phrases is None else phrases.unionByName(p)
        near = m if near is None else near.unionByName(m)
    return rows, phrases, near


def _match_block(docs, items, window, near_terms, near_span, hint):
    spark = docs.sparkSession
    words = [bytes(r[0]) for r in items.select("word").distinct().collect()]   # one block's vocabulary
    vocab = {w: i for i, w in enumerate(sorted(words))}
    ids = spark.createDataFrame([(w, i) for w, i in vocab.items()], "word binary, term int")
    seq = items.join(ids, "word").select("item", "item_id", "n", "ipos", "term")
    vocab = spark.sparkContext.broadcast(vocab)     # bounded by block_words
    seq = cut(seq.join(_counts(docs, vocab), "term", "left").fillna(0, ["df"]))

    # the rarest and second rarest position of each window, ties by position
    w = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, window - 1)
    ranked = seq.select("item", "ipos", "n", F.array_sort(F.collect_list(F.struct("df", "ipos", "term")).over(w)).alias("r"))
    whole = F.least(F.col("n"), F.lit(window))
    picks = ranked.filter((F.size("r") == whole)).select(
        "item", F.col("r")[0].alias("a"), F.get("r", F.lit(1)).alias("b"))
    picks = cut(picks.select("item", F.col("a.term").alias("term"), F.col("a.ipos").alias("ipos"),
                             F.coalesce("b.term", "a.term").alias("term2"),
                             F.coalesce("b.ipos", "a.ipos").alias("ipos2"), F.col("a.df").alias("df")).distinct())
    seeds = np.array([r[0] for r in picks.select("term").distinct().collect()], np.int64)
    index = cut(_postings(docs, vocab, seeds, window))
    rows = index.filter("term = -1").select("doc_id", "doc", F.col("pos").alias("n_words"))
    post = index.filter("term >= 0").select("doc", "term", "pos")

    # offset-adjusted lists of the rarest words, then of the second rarest
    cand = post.join(hint(picks), "term").select(
        "doc", "item", (F.col("pos") - F.col("ipos")).alias("diag"), F.col("term2").alias("term"),
        (F.col("pos") - F.col("ipos") + F.col("ipos2")).alias("pos")).distinct()
    left = cand.join(post, ["doc", "pos", "term"], "left_semi").select("doc", "item", "diag").distinct()
    # all other words of the item on the same diagonal
    spots = left.join(hint(seq.select("item", "item_id", "n", "ipos", "term")), "item").withColumn(
        "pos", F.col("diag") + F.col("ipos"))
    found = spots.join(post, ["doc", "pos", "term"], "left_semi")
    run = Window.partitionBy("doc", "item", "diag").orderBy("ipos")
    phrases = (found.withColumn("g", F.col("ipos") - F.row_number().over(run))
               .groupBy("doc", "item", "item_id", "diag", "g", "n")
               .agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
               .filter(F.col("stop") - F.col("start") + 1 >= F.least("n", F.lit(window)))
               .select("doc", "item_id", "diag", "start", "stop"))

    terms = picks.select("item", "term", "df").distinct()
    rare = Window.partitionBy("item").orderBy("df", "term")
    top = terms.withColumn("k", F.row_number().over(rare)).filter(F.col("k") <= near_terms)
    top = top.join(top.groupBy("item").agg(F.max("k").alias("need")), "item").filter("need > 1")
    top = top.join(seq.select("item", "item_id").distinct(), "item")
    span = Window.partitionBy("doc", "item").orderBy("pos").rangeBetween(-near_span, 0)
    near = (post.join(hint(top.select("item", "item_id", "term", "need")), "term").distinct()
            .withColumn("seen", F.size(F.collect_set("term").over(span)))
            .filter("seen = need").select("doc", "item_id", "pos"))
    return rows, phrases, near


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                  **params) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near)
    for every row of ``docs``. A document word inside an exact window match
    is hit; contaminated when one word in twenty or more is. items_sha256 is
    over the matched item ids, sorted as strings and joined with commas;
    n_near counts items with a proximity match. A null item id is left out
    of n_items and the list, but its windows hit. Rows are told apart by 128
    bits of id and text, a null unlike any value; repeated rows come back
    repeated. Empty tables give zeros."""
    return _report(documents(docs, id_col, text), benchmark, text=text, **params).drop("doc")


def _report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    rows, phrases, near = find_matches(docs, benchmark, **params)
    phrases = cut(phrases)
    hits = (phrases.select("doc", F.explode(F.sequence("start", "stop")).alias("p")).distinct()
            .groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit")))
    named = phrases.groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    close = near.groupBy("doc").agg(F.count_distinct("item_id").alias("n_near"))
    by_doc = cut(hits.join(named, "doc", "full").join(close, "doc", "full"))
    d = rows.join(by_doc, "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return d.select(
        "doc_id", "doc", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                        **params) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept."""
    bad = _report(documents(docs, id_col, text), benchmark, text=text, **params).filter("contaminated").select("doc").distinct()
    d = docs.select(F.struct(*docs.columns).alias("row"), identity(id_col, text).alias("doc"))
    return d.join(bad, "doc", "left_anti").select("row.*")
