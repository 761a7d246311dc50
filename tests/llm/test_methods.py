"""Methods that SQL cannot express, against enumeration or their law: rank-order
profiles, Viterbi decoding and the field's fit, equal bytes of shards."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from blockwise.llm import kdshard, langid, quality
from conftest import SF_MID

END = "\x01"


def grams(text):
    """n-grams of 1 to 3 letters with their counts; END stands before and after a word."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    s = END + END.join(words) + END if words else ""
    out = Counter(c for c in s if c != END)
    out.update(s[i:i + 2] for i in range(len(s) - 1))
    out.update(s[i:i + 3] for i in range(len(s) - 2) if s[i + 1] != END)
    return out


def order(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], len(g), [ord(c) for c in g]))[:size]


def test_language_distances_by_brute_force(spark):
    rnd = random.Random(4)
    letters = {"en": "abcde", "de": "cdefü", "xx": "aeiou"}
    rows = []
    for i in range(60):
        lang = rnd.choice(list(letters))
        text = " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 40)))
        rows.append((i, text.replace(" a", rnd.choice([" A", ", a", "\na"])), rnd.choice([lang, lang, None])))
    rows += [(None, "abc", "en"), (70, None, "en"), (71, "", "de"), (72, "12 !", "de"), (73, "İ ß x", None), (1, *rows[1][1:])]
    size = 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    sums = {}
    for i, t, lang in rows:
        if not held(i) and lang and t is not None:
            sums.setdefault(lang, Counter()).update(grams(t))
    profile = {k: {g: r for r, g in enumerate(order(c, size))} for k, c in sums.items()}
    want = []
    for i, t, _ in rows:
        own = order(grams(t), size)
        away = {k: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(own)) for k, p in profile.items()}
        best = min(sorted(away), key=away.get) if own else "und"
        want.append((i, held(i), best, 1 - away[best] / (size * len(own)) if own else 0.0))
    got = [tuple(r) for r in langid.identify(df, profile=size).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-12


def path_score(crf, x, states):
    s = crf.start[states[0]] + sum(float(x[t] @ crf.emit) for t, k in enumerate(states) if k)
    return s + sum(crf.move[a, b] for a, b in zip(states, states[1:]))


def test_viterbi_finds_the_best_sequence():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 3, 7):
        for _ in range(20):
            crf = quality.LineCRF(rnd.normal(size=quality.FEATURES), rnd.normal(size=2), rnd.normal(size=(2, 2)))
            x = rnd.normal(size=(n, quality.FEATURES))
            got = crf.decode(x).tolist()
            best = max(path_score(crf, x, s) for s in itertools.product((0, 1), repeat=n))
            assert len(got) == n and math.isclose(path_score(crf, x, got), best, abs_tol=1e-9)


def test_fit_raises_the_likelihood():
    """The penalised likelihood by enumeration: above that of no weights, and no small step improves it much."""
    rnd = np.random.default_rng(6)
    seqs = [rnd.normal(size=(n, quality.FEATURES)) + 0.4 * k for k in (0, 1) for n in (1, 3, 5, 2)]
    states = [0] * 4 + [1] * 4

    def value(emit, start, move):
        crf = quality.LineCRF(emit, start, move)
        out = 0.0
        for x, k in zip(seqs, states):
            every = [path_score(crf, x, s) for s in itertools.product((0, 1), repeat=len(x))]
            out += (path_score(crf, x, [k] * len(x)) - np.logaddexp.reduce(every)) / (2 * 4 * len(x))
        return out - 0.0005 * (emit @ emit + start @ start) - 0.025 * (move ** 2).sum()

    fitted = quality.LineCRF.fit(seqs, states, steps=600)
    at = [fitted.emit, fitted.start, fitted.move]
    top = value(*at)
    assert top > value(np.zeros(quality.FEATURES), np.zeros(2), np.zeros((2, 2))) + 0.1
    for _ in range(20):
        near = [p + 0.05 * rnd.normal(size=p.shape) for p in at]
        assert value(*near) < top + 1e-3


def shard_bytes(df):
    got = kdshard.shard_documents(df).cache()
    per = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"),
                                   F.countDistinct("slot").alias("slots")).collect()
    assert len(per) == kdshard.SHARDS and got.count() == df.count()
    assert all(r["n"] == r["slots"] == r["last"] + 1 for r in per)
    mean = sum(r["b"] for r in per) / kdshard.SHARDS
    return got, max(abs(r["b"] - mean) / mean for r in per)


def test_shards_have_equal_bytes(spark):
    got, off = shard_bytes(spark.read.parquet(f"{SF_MID}/documents.parquet"))
    assert off < 0.03
    apart = got.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("k")).filter("k > 1")
    assert apart.count() == 0       # copies of a text stay together


def test_shards_of_one_hot_text(spark):
    """One text on half of the bytes is spread over shards, which stay equal."""
    hot = spark.range(1500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("same "), 40).alias("text"))
    rest = spark.range(1500, 3000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 50).alias("text"))
    _, off = shard_bytes(hot.union(rest).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source")))
    assert off < 0.1
