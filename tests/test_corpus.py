"""Packing, vocabulary, encode/decode, caps and the BPE job against plain
Python models on the sf0.001 documents."""

import re

import pytest
from pyspark.sql import functions as F

from blockwise.operators import corpus as C
from blockwise.plans import views as V
from conftest import SF_SMALL

WORD = re.compile(r"[^ \t\r\n]+")


def stream_of(spark, split):
    docs = (V.corpus(spark, SF_SMALL).filter(F.col("split") == split)
            .select("doc_id", "text").orderBy("doc_id").collect())
    out = []
    for r in docs:
        out += WORD.findall(r.text or "") + ["<eos>"]
    return out


@pytest.mark.parametrize("L", [7, 64, 256])
def test_pack_blocks_matches_plain_model(spark, L):
    d = C.token_offsets(V.tokens(spark, SF_SMALL))
    got = {(r.split, r.block_id): (r.x, r.y) for r in C.pack_blocks(d, L).collect()}
    for split in ("train", "validation"):
        ids = stream_of(spark, split)
        n = len(ids) // L - 1
        assert sum(1 for k in got if k[0] == split) == max(n, 0)
        for i in range(max(n, 0)):
            x, y = got[(split, i)]
            assert x == ids[i * L:i * L + L]
            assert y == ids[i * L + 1:i * L + 1 + L]


def test_blocks_do_not_depend_on_partitioning(spark):
    t = V.tokens(spark, SF_SMALL)
    a = C.pack_blocks(C.token_offsets(t), 32).orderBy("split", "block_id").collect()
    b = C.pack_blocks(C.token_offsets(t.repartition(5)), 32) \
        .orderBy("split", "block_id").collect()
    assert a == b


def test_too_short_corpus_gives_no_blocks(spark):
    df = spark.createDataFrame([(1, "train", "a b c"), (2, "train", ""), (3, "train", None)],
                               "doc_id long, split string, text string")
    d = C.token_offsets(C.tokenize_words(df))
    assert C.pack_blocks(d, 16).count() == 0
    rep = C.corpus_report(d, 16, 4).collect()[0]
    assert (rep.n_docs, rep.n_tokens, rep.n_blocks, rep.n_batches) == (3, 6, 0, 0)
    # every document, empty ones included, gets one end marker
    assert [r.n for r in d.orderBy("doc_id").collect()] == [4, 1, 1]


def test_vocab_and_round_trip(spark):
    t = V.tokens(spark, SF_SMALL)
    v = C.build_vocab(t)
    rows = v.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    keys = [(-r["count"], r.tok.encode()) for r in rows]
    assert keys == sorted(keys)
    enc = C.encode_ids(t.select("doc_id", "toks"), v)
    dec = C.decode_ids(enc, v, out="back")
    j = t.join(dec, "doc_id").select(
        "doc_id", F.filter("toks", lambda s: s != "<eos>").alias("a"),
        F.filter("back", lambda s: s.isNotNull()).alias("b"))
    assert j.filter(F.col("a") != F.col("b")).count() == 0


def test_head_docs_binding_cap(spark):
    c = V.corpus(spark, SF_SMALL)
    h = C.head_docs(c.filter("split = 'train'"), 17).select("doc_id")
    want = [r.doc_id for r in c.filter("split = 'train'").orderBy("doc_id").limit(17).collect()]
    assert sorted(r.doc_id for r in h.collect()) == want
    assert C.validation_cap(None) == 20000 and C.validation_cap(300) == 300


def test_check_special_modes(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "bad <|endoftext|> here")], "doc_id long, text string")
    assert C.check_special(df, ["<|endoftext|>"], mode="drop").count() == 1
    assert C.check_special(df, ["<|endoftext|>"], mode="count").collect()[0][0] == 1
    with pytest.raises(Exception):
        C.check_special(df, ["<|endoftext|>"], mode="error").collect()


def test_bpe_matches_tiktoken(spark):
    import tiktoken
    from blockwise.operators.bpe import bpe_encode, byte_level_spec, eos_id
    spec = byte_level_spec()
    enc = tiktoken.Encoding(spec.name, pat_str=spec.pattern, mergeable_ranks=spec.ranks,
                            special_tokens=spec.special)
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.ids for r in d.select("doc_id", bpe_encode(F.col("text")).alias("ids")).collect()}
    for r in d.collect():
        assert got[r.doc_id] == enc.encode_ordinary(r.text or "") + [eos_id(spec)]


def test_bpe_holds_the_ids_of_one_slice(spark):
    import tracemalloc

    import pandas as pd
    from blockwise.operators.bpe import SLICE_CHARS, bpe_encode, byte_level_spec, encode_slices
    texts = pd.Series(["ab " * 40000, None, "", "x" * 10] * 100)
    list(encode_slices(texts[:2], byte_level_spec(), 256))
    tracemalloc.start()
    n = [[len(i) for i in ids] for ids in encode_slices(texts, byte_level_spec(), 256)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n, []) == [120001, 1, 1, 11] * 100 and len(n) == 12 and all(sum(x) <= 2 * SLICE_CHARS for x in n)
    assert peak < 16 * SLICE_CHARS      # all ids at once are 48 MB as arrays, 96 MB as lists
    rows = [(i, "é😀 b" * (i * 40000)) for i in range(9)] + [(9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = bpe_encode(F.col("text"))
    d = d.select("doc_id", F.size(ids).alias("n"), F.element_at(ids, -1).alias("last"))
    got = {r.doc_id: (r.n, r.last) for r in d.collect()}
    assert got == {i: (len((t or "").encode()) + 1, 256) for i, t in rows}


def test_vocab_refuses_a_typed_end_marker(spark, tmpdir_path):
    from blockwise.plans.queries import word_vocab
    for name, text in (("typed", "a\t<eos> b"), ("inside", "a<eos> <eos>b")):
        spark.createDataFrame([(1, text, "en", "s"), (2, None, "en", "s")],
                              "doc_id long, text string, lang string, source string").write.parquet(f"{tmpdir_path}/{name}/documents.parquet")
    with pytest.raises(Exception, match="end-of-text marker"):
        word_vocab(spark, f"{tmpdir_path}/typed").collect()
    assert {r.tok for r in word_vocab(spark, f"{tmpdir_path}/inside").collect()} == {"a<eos>", "<eos>b"}


def test_stored_blocks_prune_what_they_read(spark, tmpdir_path):
    """A split is a partition filter and the batch cap reaches the scan; the batches equal the unstored ones."""
    from blockwise.operators import batching as Bt
    from blockwise.sources import blocks as B
    from blockwise.sources.corpus import read_corpus
    blocks = spark.range(100).select(F.when(F.col("id") < 70, "train").otherwise("validation").alias("split"),
                                     F.when(F.col("id") < 70, F.col("id")).otherwise(F.col("id") - 70).alias("block_id"),
                                     F.array("id").alias("x"), F.array(F.col("id") + 1).alias("y"))
    B.write_blocks(blocks.repartition(7), tmpdir_path)
    got = B.stored_eval_batches(spark, tmpdir_path, "validation", 8, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "LessThan(block_id,16)" in plan
    want = Bt.eval_batches(blocks.filter("split = 'validation'"), 8, 2).select("batch_id", "slot", "block_id", "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 16
    assert B.stored_eval_batches(spark, tmpdir_path, "validation", 8, 99).count() == 24
    plan = read_corpus(spark, tmpdir_path, "train", columns=("block_id",))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<block_id:bigint>" in plan and "PartitionFilters: [isnotnull(split" in plan


def test_ids_are_sorted_without_a_comparator(spark):
    """A document's ids go back in order by the built-in sort, not by a comparator called for every two tokens."""
    t = spark.createDataFrame([(1, ["b", "a", "b", "<eos>"]), (2, ["<eos>"])], "doc_id long, toks array<string>")
    v = C.with_eos(C.build_vocab(t))
    enc = C.encode_ids(t, v)
    dec = C.decode_ids(enc, v)
    plan = dec._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    assert {r.doc_id: r.ids for r in enc.collect()} == {1: [0, 1, 0, 2], 2: [2]}
    assert sorted(map(tuple, dec.collect())) == sorted(map(tuple, t.collect()))


@pytest.mark.parametrize("limit", [C.MAX_STARTS_BYTES, 0])
def test_starts_return_to_their_rows_by_place(spark, limit):
    """Whatever the rows hold: ids repeat and are null, rows are missing."""
    rows = [(f"f{i % 3}", 7 * i, i // 4 or None, f"t{i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "file string, row long, doc_id long, text string").repartition(5)
    at = spark.createDataFrame([(f, r, r * 10 + int(f[1])) for f, r, _, _ in rows], "file string, row long, start long")
    got = C.put_starts(docs, at, limit).select("file", "row", "doc_id", "text", "start").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(*r, r[1] * 10 + int(r[0][1])) for r in rows], key=str)
    assert C.put_starts(docs, at.limit(0), limit).count() == 0


def test_even_scans_are_not_dealt_out(spark, tmpdir_path):
    """As many equal partitions as cores stay; a scan whose rows stand in one of them is dealt out."""
    from blockwise.sources.corpus import spread
    n = spark.sparkContext.defaultParallelism
    shuffles = lambda d: "Exchange" in d._jdf.queryExecution().executedPlan().toString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(4 * n))
        even = spark.range(0, 40 * n, 1, n)
        one = even.filter(F.col("id") < 40)
        few = spark.range(0, 40, 1, 1)
        assert [shuffles(spread(d, "id")) for d in (even, one, few)] == [False, True, True]
        assert spread(one, "id").count() == 40 and spread(even.filter("id < 0"), "id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))


def test_embed_tokens_orders_counts_alone(spark, tmpdir_path, monkeypatch):
    """Neither texts nor tokens are written, by the whole and by the large
    table's join; results as in a plain model (null and repeated ids)."""
    from blockwise import session
    from blockwise.operators import hotkeys, prefix, routing
    from blockwise.plans.queries import embed_tokens
    texts = ["a b a", None, "c  a\tb", "", "a d", "b b b b", "e"]
    docs = [(i if i else None, texts[i % 7]) for i in range(90)] + [(20, texts[6])] * 2
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source").repartition(3).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(i, [i / 8, 1.0], 0) for i in range(66)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmpdir_path}/embeddings.parquet")
    toks = {d: WORD.findall(t or "") for d, t in docs}
    n = {}
    for d, _ in docs:
        for w in toks[d]:
            n[w] = n.get(w, 0) + 1
    ids = {w: i for i, w in enumerate(sorted(n, key=lambda w: (-n[w], w)))} | {"<eos>": len(n)}
    want = []
    for split in ("train", "validation"):
        mine = sorted([d for d, _ in docs if (d is not None and d % 10 == 0) == (split == "validation")], key=lambda d: -1 if d is None else d)
        stream = [(d, w) for d in mine for w in [*toks[d], "<eos>"]]
        want += [(split, d, g, ids[w], g % 64, round((ids[w] + g % 64) / 8 + 2, 6)) for g, (d, w) in enumerate(stream)]
    written, real = [], session.cut
    for m in (session, hotkeys, prefix, routing, C):
        monkeypatch.setattr(m, "cut", lambda df, *a: (written.append(set(df.columns)), real(df, *a))[1])
    defaults = routing.embed_tokens.__defaults__
    try:
        for limit in (routing.MAX_BROADCAST_BYTES, 3000):
            routing.embed_tokens.__defaults__ = tuple(limit if x == routing.MAX_BROADCAST_BYTES else 2 if x == routing.HOT_EMB_ROWS else x for x in defaults)
            got = embed_tokens(spark, tmpdir_path).collect()
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    finally:
        routing.embed_tokens.__defaults__ = defaults
    assert not [w for w in written if w & {"text", "toks", "gpos"}]
