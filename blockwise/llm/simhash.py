"""SimHash near-duplicate classes by vantage-point trees.

Fingerprints that differ in at most ``max_bits`` bits are linked; a class is
a connected component of links. The bits are dealt into ``blocks`` groups.
The Hamming distance inside one group is a (pseudo-)metric, and a linked
pair is within ``max_bits // blocks`` in at least one group. Each group has
its own vantage-point tree: a node holds a vantage point and the median
distance to it, a branch is pruned when the triangle inequality shows that
it can hold no partner, and a fingerprint whose ball crosses the boundary is
sent to the shards on both sides. With ``blocks = max_bits + 1`` the radius
is 0 and no ball crosses; with ``blocks = 1`` it is the plain tree over all
64 bits, which sends every fingerprint to most shards (the distance to any
point concentrates around 32, and radius 4 prunes little).

Trees are built from a bounded sample of fingerprints (``sample``); every
fingerprint is indexed. A shard that is still larger than ``shard_rows`` is
split by the whole 64-bit distance to one of its own points: shell d meets
shells d .. d + max_bits only, which is again the triangle bound. A task
returns a spanning forest of its shard, never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from blockwise.llm.common import cut, utf8
from blockwise.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SAMPLE = 32768       # fingerprints the trees are built from
LEAF_ROWS = 1024     # fingerprints a shard should hold
SHARD_ROWS = 16384   # beyond this a shard is split into shells

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one text (0 when it has no word)."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, stops)])
    seen = np.frombuffer(raw, np.uint8).reshape(n, 8)
    ones = np.zeros((8, 256), np.int64)
    for at in range(0, n, 1 << 20):
        part = seen[at:at + (1 << 20)] + _BYTE
        ones += np.bincount(part.ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (ones @ _BITS) > n).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprint_column(text: str = "text", shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def fp(b: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in b], dtype="int64")

    return fp.asNondeterministic()(utf8(text))


def block_masks(blocks: int) -> list[int]:
    """The 64 bits dealt into ``blocks`` runs of nearly equal width."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


class VPTree:
    """Vantage-point tree over ``x & mask`` with Hamming distance. Children
    are node numbers; a leaf is written as -1 - leaf number."""

    def __init__(self, points: np.ndarray, mask: int, leaf: int):
        self.mask = np.uint64(mask)
        self.vantage, self.median, self.child = [], [], []
        self.leaves = 0
        todo = [(np.unique(points & self.mask, return_counts=True), None, 0)]
        self.root = 0
        while todo:
            (values, counts), parent, side = todo.pop()
            at, split = -1 - self.leaves, None
            if counts.sum() > leaf and len(values) > 1:
                split = self._split(values, counts)
            if split is None:
                self.leaves += 1
            else:
                at = len(self.vantage)
                v, m, near = split
                self.vantage.append(v)
                self.median.append(m)
                self.child.append([0, 0])
                todo += [((values[near], counts[near]), at, 0), ((values[~near], counts[~near]), at, 1)]
            if parent is None:
                self.root = at
            else:
                self.child[parent][side] = at
        self.vantage = np.array(self.vantage, np.uint64)
        self.median = np.array(self.median, np.int64)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    @staticmethod
    def _split(values, counts):
        best = None
        for v in values[np.linspace(0, len(values) - 1, min(8, len(values))).astype(int)]:
            d = np.bitwise_count(values ^ v).astype(np.int64)
            order = np.argsort(d, kind="stable")
            half = np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)
            m = int(d[order[min(half, len(order) - 1)]])
            for cut_at in (m, m - 1):
                near = d <= cut_at
                gap = abs(2 * counts[near].sum() - counts.sum())
                if near.any() and not near.all() and (best is None or gap < best[0]):
                    best = (gap, v, cut_at, near)
        return best and best[1:]

    def shards(self, x: np.ndarray, radius: int):
        """(index into x, leaf, home) of every leaf whose points may lie
        within ``radius``; home marks the leaf that x itself belongs to."""
        idx = np.arange(len(x))
        node, home = np.full(len(x), self.root), np.ones(len(x), bool)
        out = []
        while len(idx):
            end = node < 0
            out.append((idx[end], -1 - node[end], home[end]))
            idx, node, home = idx[~end], node[~end], home[~end]
            if not len(idx):
                break
            d = np.bitwise_count((x[idx] ^ self.vantage[node]) & self.mask).astype(np.int64)
            gap = d - self.median[node]
            side = (gap > 0).astype(np.int64)
            cross = np.where(side == 0, gap + radius > 0, gap - radius <= 0)
            near, far = self.child[node, side], self.child[node, 1 - side][cross]
            idx = np.concatenate([idx, idx[cross]])
            home = np.concatenate([home, np.zeros(len(far), bool)])
            node = np.concatenate([near, far])
        return [np.concatenate(z) for z in zip(*out)] if out else [idx, node, home]


def shard_forest(x: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked inside one shard: every pair of a
    home point and any other point is compared, a star per class returned."""
    order = np.argsort(~home, kind="stable")
    x, n_home = x[order], int(home.sum())
    label = np.arange(len(x))
    step = max(1, (1 << 22) // max(1, len(x)))
    for at in range(0, n_home, step):
        rows = x[at:at + step]
        near = np.bitwise_count(rows[:, None] ^ x[None, at:]) <= max_bits
        r, c = np.nonzero(near)
        keep = c > r
        r, c = r[keep] + at, c[keep] + at
        if not len(r):
            continue
        for i, lo, hi in zip(*_runs(r)):
            labels = np.unique(np.append(label[c[lo:hi]], label[i]))
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    moved = label != np.arange(len(x))
    return x[label[moved]], x[moved]


def _runs(r: np.ndarray):
    cuts = np.flatnonzero(np.diff(r)) + 1
    lo = np.concatenate([[0], cuts])
    return r[lo], lo, np.concatenate([cuts, [len(r)]])


def linked_pairs(prints: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS, blocks: int | None = None,
                 sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links among the distinct fingerprints of ``prints``, enough
    of them to connect every class."""
    blocks = blocks or max_bits + 1
    radius = max_bits // blocks
    n = prints.count()
    chosen = prints.orderBy(F.xxhash64(fp), fp).limit(sample).select(fp)
    points = np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64)
    leaf = max(8, int(leaf_rows * len(points) / max(n, 1)))
    trees = [VPTree(points, m, leaf) for m in block_masks(blocks)]

    def deal(batches):
        for pdf in batches:
            x = pdf[fp].to_numpy(np.int64).view(np.uint64)
            for t, tree in enumerate(trees):
                i, at, home = tree.shards(x, radius)
                yield pd.DataFrame({"x": x[i].view(np.int64), "tree": t, "leaf": at, "home": home})

    dealt = prints.select(fp).mapInPandas(deal, "x long, tree int, leaf long, home boolean")
    dealt = cut(dealt)
    # one row per leaf of a tree: at most blocks * sample / 8 rows
    large = (dealt.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("v"))
             .filter(F.col("n") > shard_rows).select("tree", "leaf", "v"))
    shell = F.bit_count(F.col("x").bitwiseXOR(F.col("v"))).cast("int")
    d = dealt.join(F.broadcast(large), ["tree", "leaf"], "left")
    d = d.withColumn("shell", F.explode(
        F.when(F.col("v").isNull(), F.array(F.lit(-1)))
        .otherwise(F.sequence(shell, shell + max_bits))))
    d = d.withColumn("own", F.col("home") & (F.col("v").isNull() | (F.col("shell") == shell)))
    if radius:      # with shells, guests of the leaf meet homes on either side
        back = (d.filter(F.col("v").isNotNull() & ~F.col("home") & (F.col("shell") == shell))
                .withColumn("shell", F.explode(F.sequence(shell - max_bits, shell - 1))))
        d = d.unionByName(back)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_forest(pdf["x"].to_numpy(np.int64).view(np.uint64),
                            pdf["own"].to_numpy(bool), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (d.select("tree", "leaf", "shell", "x", "own").groupBy("tree", "leaf", "shell")
            .applyInPandas(solve, "a long, b long"))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS, **index) -> DataFrame:
    """(``id_col``, fp long, class long, component_id): one row per input row;
    class is one fingerprint of its class, component_id the smallest id
    reachable over links. Null and wordless texts have fingerprint 0 and are
    linked like any other; equal fingerprints share a class; a null id is
    ignored by the minimum, and a class of null ids only has a null
    component_id. Repeated rows come back repeated; other columns of the
    input are not read. An empty table gives an empty result."""
    rows = cut(docs.select(F.col(id_col), fingerprint_column(text, shingle).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min(id_col).alias("low")))
    nodes = connected_components(linked_pairs(prints.select("fp"), max_bits=max_bits, **index))
    classed = cut(prints.join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
                  .select("fp", "low", F.coalesce("root", "fp").alias("class")))
    lows = classed.groupBy("class").agg(F.min("low").alias("component_id"))
    of = classed.join(lows, "class").select("fp", "class", "component_id")
    return rows.join(of, "fp").select(id_col, "fp", "class", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id (null
    ids last). Of rows with that id, fingerprint and class, one stays."""
    names = docs.columns
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("fp")))
    chosen = (simhash_classes(docs, id_col, text, **params).groupBy("class").agg(best.alias("b"))
              .select(F.col("b.id").alias("_id"), F.col("b.fp").alias("_fp")))
    d = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_key"),
                    F.xxhash64(id_col, text).alias("_order"),
                    fingerprint_column(text, params.get("shingle", SHINGLE)).alias("_print"))
    kept = d.join(chosen, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_fp")))
    return kept.groupBy("_key", "_print").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
