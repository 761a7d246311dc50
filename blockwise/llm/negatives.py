"""Hard negatives by residue-number-system matrix products.

Vector components become integers (``floor(scale * x)``) and a score is an
integer inner product. It is computed modulo several small primes: for each
prime the symmetric residues of anchors and rows are multiplied in float32,
where a slab of dimensions is short enough that every partial sum is below
2^24 and so exact. Chinese remaindering in symmetric mixed radix gives the
signed score: the primes' product exceeds twice the largest squared norm,
which bounds every score (Cauchy and Schwarz).

Anchors are the query set. They are numbered and taken in blocks of bounded
bytes; a block is broadcast and meets every row, each task keeping a few
best rows for each anchor, and a window over what the tasks kept selects. The
first sweep finds an anchor's positives, the second the rows of other labels
whose score lies in the window below each positive. A block's results are
written, so a lost executor costs one block at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from blockwise.llm.common import cut, scratch_path
from blockwise.operators.prefix import ranged_rank

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)           # percent of the positive's score
EXACT = 1 << 24             # float32 holds every integer up to here
SLAB = 4096                 # dimensions multiplied at once
MAX_SCORE = 1 << 55
BLOCK_BYTES = 16 << 20      # anchors broadcast at once
TILE = (512, 2048)          # anchors and rows whose scores a task holds


def primes_for(dims: int, bound: int) -> list[int]:
    """The largest odd primes whose symmetric residues give exact float32
    sums over ``dims`` dimensions, as many as bring their product above
    2 * bound + 1."""
    half = math.isqrt(EXACT // max(1, min(dims, SLAB)))
    out, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound + 1:
        while any(p % q == 0 for q in range(3, math.isqrt(p) + 1, 2)):
            p -= 2
        out.append(p)
        product *= p
        p -= 2
    return out


def symmetric(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of integers between -(p - 1) / 2 and (p - 1) / 2."""
    return (x + p // 2) % p - p // 2


class ResidueMatrix:
    """Integer rows as one float32 matrix for each prime."""

    def __init__(self, ints: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [symmetric(ints, p).astype(np.float32) for p in primes]

    def __getitem__(self, rows) -> ResidueMatrix:
        out = ResidueMatrix.__new__(ResidueMatrix)
        out.primes, out.parts = self.primes, [m[rows] for m in self.parts]
        return out

    def scores(self, other: ResidueMatrix) -> np.ndarray:
        """Exact signed inner products of all rows with all of ``other``."""
        value = base = None
        for p, a, b in zip(self.primes, self.parts, other.parts):
            r = np.zeros((len(a), len(b)), np.int64)
            for at in range(0, a.shape[1], SLAB):
                r += (a[:, at:at + SLAB] @ b[:, at:at + SLAB].T).astype(np.int64)
            if value is None:
                value, base = symmetric(r, p), p
            else:       # the next digit of the mixed radix
                value += base * symmetric((r - value) % p * pow(base, -1, p), p)
                base *= p
        return value


def integers(vectors: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of every component; missing trailing ones are 0."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(scale))
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each slot, higher scores first, ties by
    smaller id."""

    def __init__(self, slots: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.low, self.low_id = floor.copy(), np.full(slots, np.iinfo(np.int64).max)

    def enters(self, score: np.ndarray, ids: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """True where a score (slots x ids) beats the last one kept."""
        low = self.low[slots][:, None]
        mask = score > low
        ties = score == low
        if ties.any():
            mask |= ties & (ids[None, :] <= self.low_id[slots][:, None])
        return mask

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = rank[keep] == self.k - 1
        self.low[self.slot[full]], self.low_id[self.slot[full]] = self.score[full], self.id[full]


def _sweep(rows: DataFrame, block, k: int, same: bool, dims: int, primes: list[int], scale: float) -> DataFrame:
    """(slot, id, score): of each task the ``k`` best rows of every slot, an
    anchor with a range of scores (``anchor, lo, hi``), among the rows of its
    label (``same``, itself left out) or of all others."""
    def search(batches):
        b = block.value
        anchors = ResidueMatrix(b["ints"], primes)
        best = Best(len(b["anchor"]), k, b["lo"].copy())
        ranges = [np.flatnonzero((b["anchor"] >= at) & (b["anchor"] < at + TILE[0])) for at in range(0, len(b["ints"]), TILE[0])]
        for batch in batches:
            for start in range(0, batch.num_rows, TILE[1]):
                part = batch.slice(start, TILE[1])
                vec = part.column(3)
                own = ResidueMatrix(integers(vec, dims, scale), primes)
                rid, ids, label = (part.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                for at, slots in zip(range(0, len(b["ints"]), TILE[0]), ranges):
                    if not len(slots):
                        continue
                    here = slice(at, at + TILE[0])
                    score = anchors[here].scores(own)
                    fits = b["label"][here][:, None] == label[None, :]
                    if same:
                        fits &= b["rid"][here][:, None] != rid[None, :]
                    else:
                        fits = ~fits
                    which = b["anchor"][slots] - at
                    # an anchor's slots stand together: one pass for each of their places
                    place = np.arange(len(slots)) - np.searchsorted(b["anchor"][slots], b["anchor"][slots])
                    for nth in range(int(place.max()) + 1):
                        s, a = slots[place == nth], which[place == nth]
                        mask = best.enters(score[a], ids, s) & fits[a] & (score[a] <= b["hi"][s][:, None])
                        x, y = np.nonzero(mask)
                        best.add(s[x], score[a[x], y], ids[y])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (best.slot, best.id, best.score)], ["slot", "id", "score"])

    return rows.select("rid", "id", "label", "vector").mapInArrow(search, "slot long, id long, score long")


def _select(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def usable(vectors: DataFrame, id_col: str, vector: str, label: Column) -> DataFrame:
    """(rid, id, label, vector) of the rows that take part, written once."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    d = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & fine)
    return cut(d.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"),
                        label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding",
                   label: Column | str = "label", scale: float = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). ``is_anchor`` is a condition on the column ``id``. An
    anchor's positives are its first ``positives`` other rows of its label;
    for each, the first ``negatives`` rows of another label whose score is
    within ``window`` percent of the positive's. Rows with a null id, label,
    vector or component, or a component that is not finite, take no part.
    Vectors of different lengths are padded with zeros. Ids need not be
    unique: equal rows are separate rows. A label may hold any share of the
    rows. Empty tables and anchors without a match give no rows; scores that
    may pass 2^55 are refused; extra columns are not read."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector, F.col(label) if isinstance(label, str) else label)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * float(scale)).cast("double"), F.lit(2.0)))
    largest = F.max(F.abs(F.array_max("vector"))).alias("hi"), F.max(F.abs(F.array_min("vector"))).alias("lo")
    dims, norm, *ends = rows.agg(F.max(F.size("vector")), F.max(square), *largest).first()
    if max((x for x in ends if x is not None), default=0.0) * scale >= 2.0 ** 28 or (norm or 0.0) > MAX_SCORE:
        raise ValueError("scores may pass 2^55: scale the vectors down")
    dims, bound = max(1, dims or 0), int((norm or 0.0) * 1.001) + 1
    primes = primes_for(dims, bound)
    anchors = cut(ranged_rank(rows.filter(is_anchor), ["rid"], out="at"))
    total = anchors.count()
    size = max(1, block_bytes // (8 * dims))
    out = scratch_path(spark, "negatives")
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    spark.createDataFrame([], schema).write.parquet(f"{out}/block=-1")
    for number, start in enumerate(range(0, total, size)):
        got = anchors.filter(F.col("at").between(start, start + size - 1)).toArrow().sort_by("at")    # one block
        names = {c: got.column(c).to_numpy() for c in ("rid", "id", "label")}
        block = {"ints": integers(got.column("vector").combine_chunks(), dims, scale), "rid": names["rid"], "label": names["label"]}
        n = got.num_rows
        top = np.iinfo(np.int64).max
        ask = spark.sparkContext.broadcast(block | {"anchor": np.arange(n), "lo": np.full(n, -top), "hi": np.full(n, top)})
        first = cut(_select(_sweep(rows, ask, positives, True, dims, primes, scale), positives)).toArrow()
        ask.destroy()
        anchor, score = first.column("slot").to_numpy(), first.column("score").to_numpy()
        order = np.lexsort((first.column("rank").to_numpy(), anchor))
        anchor, score, pid = anchor[order], score[order], first.column("id").to_numpy()[order]
        lo, hi = -(-score * window[0] // 100), score * window[1] // 100
        live = np.flatnonzero(lo <= hi)         # a negative positive's window is empty
        anchor, score, pid, lo, hi = (x[live] for x in (anchor, score, pid, lo, hi))
        ask = spark.sparkContext.broadcast(block | {"anchor": anchor, "lo": lo, "hi": hi})
        slots = spark.createDataFrame(pa.table({"slot": np.arange(len(anchor)), "anchor_id": names["id"][anchor],
                                                "positive_id": pid, "positive_score": score}))
        found = _select(_sweep(rows, ask, negatives, False, dims, primes, scale), negatives)
        # at most ``positives`` slots for each anchor of the block
        (found.join(F.broadcast(slots), "slot")
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                 "positive_score", F.col("score").alias("negative_score"))
         .write.parquet(f"{out}/block={number}"))
        ask.destroy()
    return spark.read.schema(schema).parquet(*[f"{out}/block={k}" for k in range(-1, -(-total // size))])


# columns as hard_negatives() returns them for the query's label rule and anchors
SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.other AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
