"""Removal of long repeated substrings with a run-length (r-)index.

Every byte covered by a ``length``-byte string that also starts anywhere
else in the corpus is removed.

* Each ``length``-byte window owns an anchor: the leftmost least hash of its
  ``GRAM``-byte grams. Equal windows have equal anchors, so an anchor that
  occurs once needs no further work, and windows can only match inside the
  group of one anchor. Consecutive windows with one anchor occurrence form
  a segment of at most ``2 * length - GRAM + 1`` bytes.
* Equal segments of one anchor form a class: one text and the number of its
  copies. A passage that a third of all documents share is a handful of
  classes, counted with partial aggregation.
* Class texts are dealt by anchor to index shards of bounded size. A shard
  builds the Burrows-Wheeler transform of its texts, compresses it to runs
  and keeps the suffix positions at run ends. At these samples (and where a
  text begins) the matching statistic is measured; between samples it is
  streamed along the text, one less per byte, because inside a run both
  neighbours extend to the left with the same byte. Windows whose matching
  statistic reaches ``length`` are marked.
* An anchor with more than ``HOT`` classes (a passage in ever new
  surroundings) would not fit a shard. Its windows are dealt by their offset
  from the anchor into runs of ``RUN`` offsets; the bytes common to a run are
  a finer anchor, under which most classes fall together again. What still
  has too many classes there is grouped window by window by two hashes,
  which is exact too and pre-aggregates.
* Marks go back to all copies by joins on (anchor, class), and to the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from blockwise.llm.common import cut, identity, utf8

LENGTH = 200
GRAM = 32
HOT = 1024                  # classes of one anchor that a shard may hold
RUN = 16                    # window offsets that share a finer anchor
SHARD_BYTES = 1 << 20
INDEX_BYTES = 1 << 18       # texts that are sorted together (whole anchors)
SLICE = 1 << 19             # bytes that are hashed at a time

_U = np.uint64


def _mix(x: np.ndarray, mul: int) -> np.ndarray:
    x = x * _U(mul)
    x ^= x >> _U(29)
    return x


def _gram_hashes(b: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """64-bit hashes of all grams of each size (powers of two)."""
    h, n, out = _mix(b.astype(_U) + _U(1), 0x9E3779B97F4A7C15), 1, []
    while True:
        if n in sizes:
            out.append(h)
        if n == max(sizes):
            return out
        left = h[:len(h) - n] * _U(0xBF58476D1CE4E5B9)
        left ^= left >> _U(31)
        left += h[n:]
        h, n = _mix(left, 0x94D049BB133111EB), 2 * n


def _anchors(b: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int):
    """Segments of the buffer: (first start, last start, anchor start, anchor
    hash, class hash). Windows start at first[k]..last[k] for each stretch k."""
    big = 1 << ((length - 1).bit_length() - 1)       # largest power of two below length
    g, wide = _gram_hashes(b, (gram, big))
    width = length - gram + 1
    at = np.arange(len(g), dtype=_U)
    m, span = (g & ~_U(0xFFFFFF)) | at, 1
    while 2 * span <= width:
        m = np.minimum(m[:len(m) - span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:len(m) - (width - span)], m[width - span:])
    where = (m & _U(0xFFFFFF)).astype(np.int64)
    n = len(where)
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, first, 1)
    np.add.at(valid, last + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = (where[1:] != where[:-1]) | ~valid[:-1]
    new[first] = True
    s = np.flatnonzero(new & valid)
    ends = np.append(np.flatnonzero(new), n)
    e = ends[np.searchsorted(ends, s, side="right")] - 1
    e = np.minimum(e, last[np.searchsorted(first, s, side="right") - 1])
    # a segment is covered by grams of ``big`` bytes that start no later than its end
    tail = e + length - big
    c = _mix(wide[s] + (e - s).astype(_U), 0x9E3779B97F4A7C15)
    hop = s.copy()
    for _ in range(-(-(2 * length - gram) // big)):
        hop = np.minimum(hop + big, tail)
        c = _mix((c ^ (c >> _U(32))) + wide[hop], 0xD6E8FEB86659FD93)
    return s, e, where[s], g[where[s]], c


def _emit_anchors(length: int, gram: int):
    def emit(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            group, size = [], 0
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                if len(t) < length:
                    continue
                for off in range(0, len(t) - length + 1, SLICE):
                    part = t[off:off + SLICE + length - 1]
                    group.append((keys[i], off, part))
                    size += len(part)
                    if size >= SLICE:
                        yield rows(group)
                        group, size = [], 0
            if group:
                yield rows(group)

    def rows(group):
        lens = np.array([len(x[2]) for x in group])
        begin = np.cumsum(lens) - lens
        s, e, w, a, c = _anchors(np.frombuffer(b"".join(x[2] for x in group), np.uint8),
                              begin, begin + lens - length, length, gram)
        k = np.searchsorted(begin, s, side="right") - 1
        d = pa.array([x[0] for x in group], pa.binary()).take(pa.array(k))
        at = s - begin[k] + np.array([x[1] for x in group], np.int64)[k]
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), d,
             pa.array((at << 24) | ((w - s) << 12) | (e - s))], ["a", "c", "d", "p"])

    return emit


class RunLengthIndex:
    """Burrows-Wheeler transform of ``texts`` in runs, with the suffix
    positions at run ends, and the matching statistics they give."""

    def __init__(self, texts: list[bytes]):
        self.lens = np.array([len(t) for t in texts])
        # byte b is symbol b + 1, symbol 0 ends a text
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        self.begin = np.cumsum(self.lens + 1) - self.lens - 1
        joined[self.begin + self.lens] = 0
        self.n = n = len(joined)
        if n >= 1 << 21:
            raise ValueError("an index shard holds less than 2 MiB")
        bits = _U(n.bit_length())
        low = (_U(1) << bits) - _U(1)
        key, size = joined.astype(_U), 1
        while size < 4:                              # four symbols of nine bits
            key, size = (key << _U(9 * size)) | np.append(key[size:], np.zeros(min(size, n), _U)), 2 * size
        self.symbols = joined
        self.levels, deepest = [], int(self.lens.max(initial=1)) + 1
        idx = np.arange(n, dtype=_U)
        while True:
            packed = np.sort((key << bits) | idx)
            sa, value = (packed & low).astype(np.int64), packed >> bits
            rank = np.empty(n, np.int32)
            rank[sa] = np.cumsum(np.append(0, value[1:] != value[:-1]))
            self.levels.append((size, rank))
            if size >= deepest or rank[sa[-1]] == n - 1:
                break
            after = np.zeros(n, _U)
            after[:n - size] = rank[size:].astype(_U) + _U(1) if size < n else 0
            key = (rank.astype(_U) << bits) | after
            size *= 2
        bwt = joined[sa - 1]
        self.tail = np.flatnonzero(bwt[1:] != bwt[:-1])    # last row of each run but the last
        self.heads = bwt[np.append(0, self.tail + 1)]
        self.run_lengths = np.diff(np.concatenate([[0], self.tail + 1, [n]]))
        # samples: suffixes at both ends of every run, with their neighbours
        rows = np.unique(np.concatenate([[0], self.tail, self.tail + 1, [n - 1], rank_rows(sa, self.begin)]))
        self.samples, self.at_samples = sa[rows], self._with_neighbours(sa, rows)

    def _extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at i and j share, exact below the deepest
        level (which is longer than any text)."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)

        def step(size, of):
            inside = np.flatnonzero(np.maximum(i, j) + size <= self.n)
            same = inside[of[i[inside]] == of[j[inside]]]
            out[same] += size
            i[same] += size
            j[same] += size

        for size, rank in reversed(self.levels):
            step(size, rank)
        for _ in range(self.levels[0][0] - 1):
            step(1, self.symbols)
        return out

    def _with_neighbours(self, sa, rows):
        best = np.zeros(len(rows), np.int64)
        up, down = rows > 0, rows < self.n - 1
        best[up] = self._extension(sa[rows[up]], sa[rows[up] - 1])
        best[down] = np.maximum(best[down], self._extension(sa[rows[down]], sa[rows[down] + 1]))
        return best

    def matching_statistics(self) -> list[np.ndarray]:
        """For each text and position the length of the longest string from
        there that also starts elsewhere."""
        known = np.zeros(self.n, bool)
        value = np.zeros(self.n, np.int64)
        known[self.samples], value[self.samples] = True, self.at_samples
        at = np.maximum.accumulate(np.where(known, np.arange(self.n), 0))
        m = value[at] - (np.arange(self.n) - at)
        rest = np.repeat(self.begin + self.lens, self.lens + 1) - np.arange(self.n)
        m = np.minimum(m, rest)
        return [m[b:b + k] for b, k in zip(self.begin, self.lens)]


def rank_rows(sa: np.ndarray, positions: np.ndarray) -> np.ndarray:
    rows = np.empty(len(sa), np.int64)
    rows[sa] = np.arange(len(sa))
    return rows[positions]


def mark_segments(texts: list[bytes], copies: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered stretch (start, stop) of each text, (0, 0) when none. Texts
    are distinct and shorter than 2 * length, so marked windows of one text
    always meet and their union is one stretch."""
    out = []
    for ms, n in zip(RunLengthIndex(texts).matching_statistics(), copies):
        hit = np.flatnonzero(ms[:len(ms) - length + 1] >= length) if n < 2 else np.array([0, len(ms) - length])
        out.append((int(hit[0]), int(hit[-1]) + length) if len(hit) else (0, 0))
    return out


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(d, doc_id, b): d names id and text."""
    return docs.select(identity(id_col, text).alias("d"), F.col(id_col).alias("doc_id"), utf8(text).alias("b"))


def _compressed(batches):
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([z.compress(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*batch.schema.names[:-1], "z"])


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _extract(length: int):
    def extract(batches):
        for batch in batches:
            for z, want in zip(batch.column(0), batch.column(1)):
                t, want = _unpack(z.as_py()), want.as_py()
                segs = [t[w["p"] >> 24:(w["p"] >> 24) + (w["p"] & 0xFFF) + length] for w in want]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["a"] for w in want], pa.int64()), pa.array([w["c"] for w in want], pa.int64()),
                     pa.array([w["n"] for w in want], pa.int64()), pa.array([w["hot"] for w in want], pa.bool_()),
                     pa.array([(w["p"] >> 12) & 0xFFF for w in want], pa.int32()),
                     pa.array(segs, pa.binary())], ["a", "c", "n", "hot", "off", "seg"])

    return extract


def _index_shard(length: int):
    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["a", "c"]).sort_values(["a", "c"], ignore_index=True)
        a, n = pdf["a"].to_numpy(), pdf["n"].to_numpy()
        segs = [bytes(x) for x in pdf["seg"]]
        out, lo, size = [], 0, 0
        for hi in range(1, len(segs) + 1):      # whole anchor groups
            size += len(segs[hi - 1]) + 1
            if hi == len(segs) or (size >= INDEX_BYTES and a[hi] != a[hi - 1]):
                out += mark_segments(segs[lo:hi], n[lo:hi], length)
                lo, size = hi, 0
        mark = np.array(out, np.int64).reshape(-1, 2)
        found = pd.DataFrame({"a": a, "c": pdf["c"].to_numpy(), "lo": mark[:, 0], "hi": mark[:, 1]})
        return found[found["hi"] > 0]

    return index


def _shard_marks(segs: DataFrame, size: int, length: int, shard_bytes: int) -> DataFrame:
    """(a, c, lo, hi) of the marked stretches of (a, c, n, seg) by index
    shards; ``size``: bytes of all texts."""
    shards = max(1, -(-int(size) // shard_bytes))
    return (segs.select("a", "c", "n", "seg").groupBy(F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard"))
            .applyInPandas(_index_shard(length), "a long, c long, lo long, hi long"))


def _window_marks(segs: DataFrame, length: int) -> DataFrame:
    """The same, window by window."""
    part = F.transform(F.sequence(F.lit(1), F.octet_length("seg") - length + 1),
                       lambda i: F.struct(i.alias("i"), F.xxhash64(F.substring("seg", i, length)).alias("h1"),
                                          F.xxhash64(F.lit("2"), F.substring("seg", i, length)).alias("h2")))
    w = segs.select("a", "c", "n", F.explode(part).alias("w")).select("a", "c", "n", "w.*")
    often = cut(w.groupBy("a", "h1", "h2").agg(F.sum("n").alias("k")).filter("k > 1").select("a", "h1", "h2"))
    return (w.join(often, ["a", "h1", "h2"]).groupBy("a", "c")
            .agg((F.min("i") - 1).cast("long").alias("lo"), (F.max("i") - 1 + length).cast("long").alias("hi")))


def _many_classes(classes: DataFrame, hot: int) -> DataFrame:
    """Anchors with more than ``hot`` classes (counted to 2 %)."""
    return (classes.groupBy("a").agg(F.approx_count_distinct("c", 0.02).alias("m"))
            .filter(F.col("m") > hot).select("a", F.lit(True).alias("hot")))


def _hot_marks(segs: DataFrame, length: int, hot: int, shard_bytes: int) -> DataFrame:
    """The same for hot anchors, by finer anchors."""
    segs = segs.dropDuplicates(["a", "c"])
    low, high = F.col("off") - F.octet_length("seg") + length, F.col("off")       # offsets of its windows
    runs = segs.select("a", "c", "n", "off", "seg", low.alias("low"), F.explode(F.sequence(
        F.floor(low / RUN).cast("int"), F.floor(high / RUN).cast("int"))).alias("k"))
    first = F.col("off") - F.least("off", F.col("k") * RUN + RUN - 1)             # its windows of run k
    last = F.col("off") - F.greatest("low", F.col("k") * RUN)
    core = F.substring("seg", F.col("off") - F.col("k") * RUN + 1, F.lit(length - RUN + 1))
    part = F.substring("seg", first + 1, last - first + length)
    runs = cut(runs.select("a", "c", "n", first.alias("first"), part.alias("seg"),
                           F.xxhash64("a", "k", core).alias("a2"), F.xxhash64(part).alias("c2")))
    finer = runs.select(F.col("a2").alias("a"), F.col("c2").alias("c"), "n", "seg").groupBy("a", "c").agg(
        F.sum("n").alias("n"), F.min("seg").alias("seg"))
    finer = cut(finer.join(_many_classes(finer, hot), "a", "left"))
    size = finer.agg(F.sum(F.octet_length("seg"))).first()[0] or 0
    marks = cut(_shard_marks(finer.filter("hot is null"), size, length, shard_bytes).union(
        _window_marks(finer.filter("hot"), length)).select(
            F.col("a").alias("a2"), F.col("c").alias("c2"), "lo", "hi"))
    return (runs.select("a", "c", "first", "a2", "c2").join(marks, ["a2", "c2"]).groupBy("a", "c")
            .agg(F.min(F.col("first") + F.col("lo")).alias("lo"), F.max(F.col("first") + F.col("hi")).alias("hi")))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(d, spans): for each text of (d, b) with repeats the sorted covered
    stretches (lo, hi) in bytes, which may overlap. Rows of one d (bytes) have
    one text, each a copy of the others."""
    if not 2 * max(gram, RUN) <= length < 2048:
        raise ValueError("length must be at least twice the gram and less than 2048")
    anchors = texts.select("d", "b").mapInArrow(_emit_anchors(length, gram), "a long, c long, d binary, p long")
    again = cut(anchors.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("a"))
    found = cut(anchors.join(again, "a"))
    classes = found.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "p")).alias("at"))
    per = found.groupBy("a").agg((F.approx_count_distinct("c", 0.02) > hot).alias("hot"),
                                 (F.min("c") == F.max("c")).alias("lone"))
    every = cut(classes.join(per, "a").select("a", "c", "n", "at.d", "at.p", "hot", "lone"))
    classes = every.filter(~F.col("lone"))
    wanted = classes.groupBy("d").agg(F.collect_list(F.struct("a", "c", "n", "p", "hot")).alias("want"))
    packed = texts.select("d", "b").mapInArrow(_compressed, "d binary, z binary")
    segs = packed.join(wanted, "d").select("z", "want").mapInArrow(
        _extract(length), "a long, c long, n long, hot boolean, off int, seg binary")
    size = classes.agg(F.sum(F.col("p").bitwiseAND(F.lit(0xFFF)) + length)).first()[0] or 0
    segs = cut(segs)
    marks = _shard_marks(segs.filter(~F.col("hot")), size, length, shard_bytes)
    marks = marks.union(_hot_marks(segs.filter("hot"), length, hot, shard_bytes))
    alone = F.col("p").bitwiseAND(F.lit(0xFFF)) + length
    marks = cut(marks.union(every.filter("lone").select("a", "c", F.lit(0).cast("long"), alone.cast("long"))))
    start = F.shiftright("p", 24)
    return (found.join(marks, ["a", "c"]).select("d", (start + F.col("lo")).alias("lo"), (start + F.col("hi")).alias("hi"))
            .groupBy("d").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per
    row of ``docs``; kept is what is left of the text, as bytes. Null counts
    as empty; texts shorter than ``length`` keep everything; repeated rows
    are copies of each other and lose all that is long enough; extra columns
    are not read; an empty table gives an empty result."""
    texts = _texts(docs, id_col, text)
    spans = repeated_spans(texts, **params)
    kind = dict(docs.dtypes)[id_col]
    packed = texts.select("doc_id", "d", "b").mapInArrow(_compressed, f"doc_id {kind}, d binary, z binary")

    def strip(batches):
        for batch in batches:
            rows = []
            for z, spans in zip(batch.column(1), batch.column(2)):
                t, at, parts, removed, runs = _unpack(z.as_py()), 0, [], 0, 0
                for x in spans.as_py() or []:
                    if x["lo"] > at or not runs:
                        parts.append(t[at:x["lo"]])
                        runs, at = runs + 1, x["lo"]
                    removed += max(0, x["hi"] - at)
                    at = max(at, x["hi"])
                kept = b"".join([*parts, t[at:]])
                rows.append((len(t), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(
                    cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return packed.join(spans, "d", "left").select("doc_id", "z", "spans").mapInArrow(
        strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
