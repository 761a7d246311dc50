"""Language identification by rank-order profiles.

A language's profile is its ``profile`` most frequent letter n-grams (1 to 3
letters, word ends marked), in order; a document's is made alike from its
whole text. The distance sums how far each of the document's n-grams is out
of place in the language's profile, ``profile`` for one that is not in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from blockwise.llm.common import cut, hash_mod

PROFILE = 400
FOLDS, HELD = 4, 2
SLICE = 1 << 20         # letters whose n-grams are counted at a time
SALT = 64


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0
    return np.char.isalpha(points.view("U1"))


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased letters, each other stretch one 0."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(table[x], x, 0)
    x = np.concatenate([[0], x, [0]]).astype(np.int64)
    return x[(x > 0) | np.append(True, x[:-1] > 0)]


def gram_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (21 bits a letter) with their counts, by slices."""
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(x), SLICE):
        y = x[at:at + SLICE + 2]
        own, middle = y[:SLICE], y[1:-1] > 0
        y = np.maximum(y, 1)        # a word's end; as 0 it would vanish at the front of a gram
        two = (y[:-1] << 21) | y[1:]
        three = (two[:-1] << 21) | y[2:]
        three = three[:SLICE][middle[:SLICE]]
        g = np.sort(np.concatenate([own[own > 0], two[:SLICE], three]))
        edge = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        g, n = g[edge], np.diff(np.append(edge, len(g)))
        if len(found):
            g, back = np.unique(np.concatenate([found, g]), return_inverse=True)
            n = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
        found, counts = g, n
    return found, counts


def ranked(grams: np.ndarray, counts: np.ndarray, profile: int) -> np.ndarray:
    """The most frequent n-grams in order, ties by n-gram."""
    return grams[np.lexsort((grams, -counts))[:profile]]


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang",
                   profile: int = PROFILE) -> dict[str, np.ndarray]:
    """{language: n-grams in rank order} from all rows with a language. A
    profile has at most ``profile`` n-grams; there are as many profiles as
    language labels."""
    def count(batches):
        table = letter_table()
        for batch in batches:
            parts: dict = {}
            for t, name in zip(batch.column(0), batch.column(1)):
                parts.setdefault(name.as_py(), []).append(letters(t.as_py(), table))
            for name, xs in parts.items():
                g, n = gram_counts(np.concatenate(xs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())],
                    ["lang", "gram", "n"])

    d = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    sums = d.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.col("gram")]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod("gram", F.lit(SALT))).orderBy(*order))
    top = sums.withColumn("r", part).filter(F.col("r") <= profile)
    whole = F.row_number().over(Window.partitionBy("lang").orderBy(*order))     # at most SALT * profile rows
    top = top.withColumn("r", whole).filter(F.col("r") <= profile).select("lang", "gram", "r")
    out: dict = {}
    for name, gram, _ in sorted(tuple(r) for r in top.collect()):
        out.setdefault(name, []).append((_, gram))
    return {k: np.array([g for _, g in sorted(v)], np.int64) for k, v in out.items()}


class Profiles:
    """All profiles in one table: a sorted list of n-grams and the rank of
    each in every language (``size`` where it is absent)."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None, table: np.ndarray) -> tuple[str, float]:
        x = letters(text, table) if text else np.zeros(1, np.int64)
        if not x.any() or not self.names:
            return "und", 0.0
        own = ranked(*gram_counts(x), self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        r = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        away = np.where(r < 0, self.size, np.abs(r - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(away))         # ties: the first name
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
             profile: int = PROFILE, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``.
    Profiles come from rows whose crc32(doc_id) modulo ``folds`` is not
    ``held`` (a null id counts as remainder 0) with a language. A null text
    or one without a letter is ``und`` with score 0, as is everything when no
    language was learned. Ties go to the first language by name. Extra
    columns are not read."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"), F.col(lang).alias("l"),
                    (hash_mod(id_col, folds) == held).alias("held_out"))
    model = Profiles(learn_profiles(d.filter(~F.col("held_out")), "t", "l", profile), profile)
    shared = docs.sparkSession.sparkContext.broadcast(model)     # profile n-grams a language

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        table = letter_table()
        return pd.DataFrame([shared.value.predict(t, table) for t in texts], columns=["lang_pred", "score"])

    d = d.select("doc_id", "held_out", predict.asNondeterministic()("t").alias("p"))
    return d.select("doc_id", "held_out", "p.*")
