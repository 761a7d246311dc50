"""Spelling variants by PartEnum signatures.

A word's letter multiset is a binary vector with one dimension for each
(letter, occurrence): "letter" has e1, e2, l1, r1, t1, t2. One inserted or
deleted letter moves one dimension, one replaced letter two, so near words
have vectors within Hamming distance two. The dimensions are dealt by hash
into ``PARTS`` parts; two vectors within distance two agree on the parts that
are left when the one or two parts that hold their difference are taken out.
The signatures of a vector are what is left of it for each choice of two
parts, so every such pair meets in an equi-join on signatures; it is kept
only under the first choice that holds its difference, hence once.

Words of one multiset are one vector, so anagrams are never paired. A vector
pair names the letter to take out and the letter to put in: each word of one
vector proposes the spellings that this gives, and an equi-join with the
words verifies them. Nothing compares all words of two groups.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from blockwise.llm.common import cut

PARTS = 7
DISTANCE = 2
TYPO = 97               # one run in so many loses a letter
MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2               # a form has so many times the occurrences
HELD_WORDS = 1 << 18    # words that a task holds before it hands on their counts

# one byte a letter: A-Z, a-z and U+00C0 to U+00FF in latin-1, a blank for the rest
_LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> Counter:
    """The maximal letter runs of a text, A-Z in lower case, with their counts."""
    return Counter(text.encode("latin-1", "replace").translate(_LETTERS).lower().split())


def misspelled(doc_id: str, run: bytes, typo: int = TYPO) -> bytes:
    h = zlib.crc32(f"{doc_id}:{run.decode('latin-1')}".encode())
    if h % typo:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", typo: int = TYPO,
                min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of ``min_letters`` code points or more that occur
    ``min_count`` times or more. Null texts have none; a null id counts as
    the empty string in the spelling rule; repeated rows count each."""
    def count(batches):
        held: Counter = Counter()

        def hand_on():
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())],
                ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                i = i.as_py()
                for run, n in runs(t.as_py()).items():
                    word = misspelled(i, run, typo)
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield hand_on()
        yield hand_on()

    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    return (d.filter("t is not null").mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def dimensions(bag: bytes) -> list[bytes]:
    """The dimensions of a sorted multiset: each letter with its occurrence."""
    out, seen = [], 0
    for k, letter in enumerate(bag):
        seen = seen + 1 if k and bag[k - 1] == letter else 1
        out.append(b"%c%d" % (letter, seen))
    return out


def part_of(dimension: bytes, parts: int = PARTS) -> int:
    return zlib.crc32(dimension) % parts


def signatures(bags: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, i, j, bag): for each choice of two parts what is left of the vector."""
    choices = [(i, j) for i in range(parts) for j in range(i + 1, parts)]

    def sign(batches):
        for batch in batches:
            keys = []
            for bag in batch.column(0):
                of: list = [[] for _ in range(parts)]
                for x in dimensions(bag.as_py().encode("latin-1")):
                    of[part_of(x, parts)].append(x)
                flat = [b",".join(xs) for xs in of]
                keys += [xxh64_intdigest(b";".join(flat[:i] + flat[i + 1:j] + flat[j + 1:]), i * parts + j)
                         for i, j in choices]
            n, c = batch.num_rows, np.array(choices, np.int8).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.tile(c[:, 0], n)),
                 pa.array(np.tile(c[:, 1], n)), batch.column(0).take(pa.array(np.repeat(np.arange(n), len(c))))],
                ["key", "i", "j", "bag"])

    return bags.select("bag").mapInArrow(sign, "key long, i byte, j byte, bag string")


def difference(a: bytes, b: bytes) -> tuple[int, int] | None:
    """Where ``a`` without a[at] is ``b`` without b[to]: (at, to), to = -1
    when ``b`` is one letter shorter and nothing of it goes; else None. Both
    are sorted and different."""
    n, m = len(a), len(b)
    k = next((k for k in range(m) if a[k] != b[k]), m)
    e = next((e for e in range(m - k) if a[n - 1 - e] != b[m - 1 - e]), m - k)
    x, y = a[k:n - e], b[k:m - e]
    if not y:
        return (k, -1) if len(x) == 1 else None
    if len(x) != len(y):
        return None
    if x[1:] == y[:-1]:
        return k, m - e - 1
    return (n - e - 1, k) if x[:-1] == y[1:] else None


def near_bags(bags: DataFrame, parts: int = PARTS) -> DataFrame:
    """(source, out, put): words of the multiset ``source`` without the letter
    ``out`` and with ``put`` (empty: nothing) have another multiset of the
    table. Each pair of multisets comes once, from the longer of the two."""
    rows = cut(signatures(bags, parts))
    other = rows.select("key", F.col("bag").alias("other"))
    n, m = F.char_length("bag"), F.char_length("other")
    # sorted multisets within Hamming distance two are within two edits
    met = rows.join(other, "key").filter(
        ((n > m) | ((n == m) & (F.col("bag") > F.col("other")))) & (n - m <= 1)
        & (F.levenshtein("bag", "other", DISTANCE) >= 0))

    def check(batches):
        for batch in batches:
            source, out, put = [], [], []
            for i, j, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                a, b = x.encode("latin-1"), y.encode("latin-1")
                spots = difference(a, b)
                if spots is None:
                    continue
                at, to = spots
                held = {part_of(b"%c%d" % (a[at], a.count(a[at])), parts)}
                if to >= 0:
                    held.add(part_of(b"%c%d" % (b[to], b.count(b[to])), parts))
                # the first choice of parts that holds the difference
                if len(held) == 1:
                    held.add(0 if 0 not in held else 1)
                if held == {i, j}:
                    source.append(x)
                    out.append(x[at])
                    put.append(y[to] if to >= 0 else "")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (source, out, put)],
                                             ["source", "out", "put"])

    return met.select("i", "j", "bag", "other").mapInArrow(check, "source string, out string, put string")


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, other, m): both directions of every pair of different words
    of (word, n) that differ by one inserted, deleted or replaced letter."""
    bag = F.array_join(F.array_sort(F.split("word", "")), "")
    w = cut(words.select("word", "n", bag.alias("source")))
    moves = near_bags(w.select(F.col("source").alias("bag")).distinct(), parts)
    spots = F.filter(F.sequence(F.lit(1), F.char_length("word")), lambda p: F.substring("word", p, F.lit(1)) == F.col("out"))
    spelled = F.array_distinct(F.transform(spots, lambda p: F.concat(
        F.substring("word", F.lit(1), p - 1), F.col("put"), F.substring("word", p + 1, F.char_length("word")))))
    proposed = moves.join(w, "source").select("word", "n", F.explode(spelled).alias("other"))
    found = proposed.join(w.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    pairs = cut(found.select("word", "n", "other", "m"))
    return pairs.union(pairs.select("other", "m", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. A form has
    at least ``RATIO`` times the occurrences of its word, so a chain is no
    longer than the logarithm of the largest count; each round doubles the
    steps taken."""
    r = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while r.filter("moved").limit(1).count():
        ahead = r.select(F.col("word").alias("root"), F.col("root").alias("further"))
        r = cut(r.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return r.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int = PARTS,
                    typo: int = TYPO, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                    ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per counted word. n_near
    counts its near words; ``form`` is the near word with the most
    occurrences (ties: the first in code-point order) if it has ``ratio``
    times as many, else null; ``root`` is where following forms ends (the
    word itself without a form). Null, empty and letterless texts add no
    words, very long ones are read whole, repeated rows count each, an empty
    table gives an empty result and extra columns are not read."""
    words = cut(count_words(docs, id_col, text, typo, min_letters, min_count))
    near = near_words(words, parts)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("k"), F.col("other").alias("form"))).alias("b"))
    d = words.join(best, "word", "left")
    fits = -F.col("b.k") >= ratio * F.col("n")
    d = cut(d.select("word", F.when(fits, F.col("b.form")).alias("form"), "n",
                     F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(fits, -F.col("b.k")).cast("long").alias("form_n")))
    roots = _roots(d.filter("form is not null").select("word", "form"))
    return d.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
