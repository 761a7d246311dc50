"""Toxicity by gradient-boosted trees over dense features.

The lexicon holds the words whose document frequency among toxic training
documents is far above that among the others. Features: lexicon densities
(plain, weighted, after undoing obfuscation), hits near second-person words,
capitals, punctuation and obfuscation rates. Boosted trees (MLlib) are
fitted on most of the training rows and their margin is calibrated by
isotonic regression on the rest, which the lexicon has not seen either.

The lexicon and the trees are fitted on a bounded sample: at most
``train_rows`` labelled documents of each label, the first by a hash of the
id. Every document is scored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from blockwise.llm.common import cut, hash_mod, utf8

TRAIN_ROWS = 15000
FOLDS, HELD = 5, 0
LEXICON = 300
MIN_DF = 4
MIN_ODDS = 3.0
NEAR = 5
# fixed values: second-person words of the languages in the corpus
SECOND = frozenset(w.encode() for w in (
    "you", "your", "yours", "yourself", "u", "ur", "ya", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "usted", "ustedes", "ti", "tus", "vosotros"))
# fixed values: signs that stand for letters
_PLAIN = bytes.maketrans(b"013457@$!|+", b"oieastasiit")
_EDGE = b"\"'.,;:!?()[]{}<>*#%&|-_~`/\\"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_INNER = frozenset(b"0123456789@$!*.-_+|#%&")


def words_of(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def obfuscated(word: bytes) -> bool:
    """Letters with digits or signs between them."""
    inner = word[1:-1]
    return any(c in _INNER for c in inner) and len(word.translate(None, _LETTERS)) < len(word) - 1


def plain(word: bytes) -> bytes:
    """The word with its signs read as letters, other signs and repeats dropped."""
    out = bytearray()
    for c in word.translate(_PLAIN):
        if (97 <= c <= 122 or c >= 128) and (not out or out[-1] != c):
            out.append(c)
    return bytes(out)


def features(text: bytes, lexicon: dict, plain_lexicon: dict) -> list[float]:
    raw = text.split()
    words = [w.strip(_EDGE) for w in text.lower().split()]
    n = max(1, len(raw))
    get = lexicon.get
    hits = [(i, v) for i, v in enumerate(map(get, words)) if v]
    second = {i for i, w in enumerate(words) if w in SECOND} if hits else set()
    n_second = sum(map(SECOND.__contains__, words))
    near = sum(any(j in second for j in range(i - NEAR, i + NEAR + 1)) for i, _ in hits) if second else 0
    letters = len(text) - len(text.translate(None, _LETTERS))
    odd = [w for w in words if not w.isalpha() and w.isascii() and obfuscated(w)]
    undone = [v for v in (plain_lexicon.get(plain(w)) for w in odd) if v]
    upper = sum(65 <= c <= 90 for c in text) if len(text) < 64 else len(text) - len(text.translate(None, _LETTERS[:26]))
    shout = sum(w.isupper() and len(w) > 2 for w in raw)
    total = max(1, len(text))
    weights = [v for _, v in hits] + undone
    return [math.log1p(len(raw)), float(min(len(hits), 50)), 100 * len(hits) / n, 100 * sum(weights) / n,
            max(weights, default=0.0), float(min(len(undone), 50)), 100 * n_second / n, float(min(near, 50)),
            100 * near / n, upper / max(1, letters), 100 * shout / n, 100 * text.count(b"!") / total,
            100 * text.count(b"?") / total, 100 * sum(text.count(c) for c in (b"*", b"#", b"%", b"$", b"&")) / total,
            100 * len(odd) / n, float(len({w for i, w in enumerate(words) if get(w)}))]


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[bytes, float]:
    """{word: log odds} of at most ``size`` words from (b, y) rows."""
    def count(batches):
        for pdf in batches:
            seen: dict = {}
            for b, y in zip(pdf["b"], pdf["y"]):
                for w in set(words_of(b)):
                    seen.setdefault(w, [0, 0])[y] += 1
            yield pd.DataFrame({"w": list(seen), "n0": [v[0] for v in seen.values()],
                                "n1": [v[1] for v in seen.values()]})

    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    df = rows.select("b", "y").mapInPandas(count, "w binary, n0 long, n1 long").groupBy("w").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n1") >= MIN_DF)
    odds = F.log(((F.col("n1") + 0.5) / (total.get(1, 0) + 1.0)) / ((F.col("n0") + 0.5) / (total.get(0, 0) + 1.0)))
    top = (df.withColumn("odds", odds).filter(F.col("odds") >= math.log(MIN_ODDS))
           .withColumn("gain", F.col("odds") * F.col("n1")).orderBy(F.desc("gain"), "w").limit(size))
    return {bytes(r["w"]): float(r["odds"]) for r in top.collect()}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                   label: str = "toxic", folds: int = FOLDS, held: int = HELD, train_rows: int = TRAIN_ROWS,
                   trees: int = 20, depth: int = 4) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``.
    Labels are read only for rows whose crc32(doc_id) modulo ``folds`` is not
    ``held`` (a null id counts as remainder 0). Null and empty texts have the
    features of an empty text and are scored too. Without labels of both
    kinds every score is the share of label 1 (0 when there are none).
    Conflicting labels of one id count as the higher; extra columns are not
    read."""
    d = docs.select(F.col(id_col).alias("doc_id"), utf8(text).alias("b"),
                    (hash_mod(id_col, folds) == held).alias("held_out"))
    lab = (labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y"))
           .filter((hash_mod("doc_id", folds) != held) & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    picked = [lab.filter(f"y = {y}").orderBy(order, "doc_id").limit(train_rows) for y in (0, 1)]
    # at most 2 * train_rows ids; one text for each, the first by a hash where an id has several
    picked = F.broadcast(cut(picked[0].union(picked[1])))
    sample = d.join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("b").alias("h"), "b")).alias("t"))
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5))
    sample = cut(sample.select("doc_id", F.col("t.b").alias("b"), "y", part.alias("part")))
    seen = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    base = seen.get(1, 0) / max(1, sum(seen.values()))
    if len(seen) < 2:
        return d.select("doc_id", "held_out", F.lit(float(base)).alias("score"), F.lit(int(base >= 0.5)).alias("predicted"))
    lexicon = learn_lexicon(sample.filter("part > 0"))
    undone = {}
    for w, v in sorted(lexicon.items()):
        undone.setdefault(plain(w), v)

    @F.pandas_udf("array<double>")
    def dense(b: pd.Series) -> pd.Series:
        return pd.Series([features(t, lexicon, undone) for t in b])

    vector = array_to_vector(dense.asNondeterministic()("b"))
    # four parts of five fit the lexicon and the trees, the rest the calibration
    weight = F.when(F.col("y") == 1, F.lit(sum(seen.values()) / 2 / seen[1])).otherwise(
        F.lit(sum(seen.values()) / 2 / seen[0]))
    train = cut(sample.select("y", "part", weight.alias("weight"), vector.alias("features")))
    gbt = GBTClassifier(labelCol="y", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth,
                        stepSize=0.2, minInstancesPerNode=5, seed=42).fit(train.filter("part > 0"))

    def margin(frame: DataFrame) -> DataFrame:
        return gbt.transform(frame).withColumn("margin", vector_to_array("rawPrediction")[1])

    held_back = margin(train.filter("part = 0")).select("margin", "y", F.lit(1.0).alias("one"))
    if {r["y"] for r in held_back.groupBy("y").count().collect()} != {0, 1}:
        held_back = margin(train).select("margin", "y", F.lit(1.0).alias("one"))
    iso = IsotonicRegression(featuresCol="margin", labelCol="y", weightCol="one").fit(held_back)
    scored = iso.transform(margin(d.select("doc_id", "held_out", vector.alias("features"))).select(
        "doc_id", "held_out", "margin"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
