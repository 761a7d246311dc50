"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks each line as content or
boilerplate from features of the line; Viterbi decoding gives the best
sequence, and the share of words in content lines decides retention.

The field is fitted on a bounded sample of labelled documents
(``train_docs`` of each quality label, at most ``train_lines`` consecutive
lines of each, from a place that its id decides): lines of documents marked
good are content, lines of documents marked bad are boilerplate.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from blockwise.llm.common import utf8

TRAIN_DOCS = 1500
TRAIN_LINES = 40
MIN_SHARE = 0.3      # share of words in content lines that a document needs
MIN_WORDS = 50
MAX_REPEAT_PCT = 50

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_LOWER = bytes(range(97, 123))
_LEGAL = re.compile(rb"licen[cs]e|copyright|all rights reserved|warrant|cookie|subscribe|click here|privacy", re.I)
_ADDRESS = re.compile(rb"://|www\.|@|\d{3}[-. ]\d{3,4}")
FEATURES = 13


def line_features(line: bytes, words: int, again: bool) -> tuple:
    """Dense features of one line that holds a word."""
    n = len(line)
    sym = n - len(line.translate(None, SYMBOLS))
    up = n - len(line.translate(None, _UPPER))
    low = n - len(line.translate(None, _LOWER))
    dig = n - len(line.translate(None, _DIGIT))
    bang = line.count(b"!")
    pipe = line.count(b"|")
    last = line.rstrip()[-1:]
    return (1.0, min(words, 60) / 60, float(words <= 3), min(1.0, 4 * sym / n), float(sym * 12 > words),
            up / max(1, up + low), float(up > low), min(1.0, 4 * dig / n), min(1.0, bang / max(words, 1)),
            min(1.0, 2 * pipe / max(words, 1)), float(last in (b".", b"?", b"!", b";", b":")), float(again),
            float(bool(_LEGAL.search(line) or _ADDRESS.search(line))))


def read_lines(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, words) of the lines with a word, and the number of such
    lines equal to an earlier line."""
    seen, rows, counts, dup = set(), [], [], 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            key = line if len(line) < 64 else hashlib.blake2b(line, digest_size=32).digest()
            again = key in seen
            dup += again
            seen.add(key)
            rows.append(line_features(line, n, again))
            counts.append(n)
    return np.array(rows, np.float64).reshape(-1, FEATURES), np.array(counts, np.int64), dup


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict = {}
    x = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pair = x[:-1] * len(seen) + x[1:]
    if len(seen) >= 1 << 20:        # three ids no longer fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(seen) + x[2:]
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return 0
    at = np.searchsorted(twice, key)
    hit = twice[np.minimum(at, len(twice) - 1)] == key
    covered = np.zeros(len(x), bool)
    for k in range(3):
        covered[k:k + len(hit)] |= hit
    return int(covered.sum())


class LineCRF:
    """Two states, 0 content and 1 boilerplate. ``emit``: weight of each
    feature for state 1 against 0; ``start`` and ``move``: log potentials."""

    def __init__(self, emit, start, move):
        self.emit, self.start, self.move = np.asarray(emit), np.asarray(start), np.asarray(move)

    def decode(self, x: np.ndarray) -> np.ndarray:
        score = x @ self.emit
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = self.start.tolist()
        back = []
        for t, e in enumerate(score.tolist()):
            if t:
                from0, from1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
                back.append((from0, from1))
                s0, s1 = (s1 + m10 if from0 else s0 + m00), (s1 + m11 if from1 else s0 + m01)
            s1 += e
        state = int(s1 > s0)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return np.array(out[::-1], np.int64)

    @staticmethod
    def default() -> "LineCRF":
        """Used when there are no labels of both kinds: only lines full of
        symbols, capitals or separators are boilerplate."""
        emit = np.zeros(FEATURES)
        emit[[0, 4, 6, 8, 9]] = -2.5, 2.0, 2.0, 3.0, 3.0
        return LineCRF(emit, [0.0, 0.0], [[0.5, -0.5], [-0.5, 0.5]])

    @staticmethod
    def fit(seqs: list[np.ndarray], states: list[int], steps: int = 80, rate: float = 0.5,
            ridge: float = 1e-3) -> "LineCRF":
        """Penalised conditional likelihood by gradient ascent (Adagrad);
        every line of sequence i has state ``states[i]``."""
        size = max(len(s) for s in seqs)
        x = np.zeros((len(seqs), size, FEATURES))
        on = np.zeros((len(seqs), size), bool)
        for i, s in enumerate(seqs):
            x[i, :len(s)], on[i, :len(s)] = s, True
        y = np.asarray(states)
        kind = np.array([1 / max(1, (y == k).sum()) for k in (0, 1)])[y] / 2
        weight = kind / on.sum(1)
        emit, start, move = np.zeros(FEATURES), np.zeros(2), np.zeros((2, 2))
        sums = [np.full_like(p, 1e-8) for p in (emit, start, move)]
        for _ in range(steps):
            node = np.zeros((len(seqs), size, 2))
            node[:, :, 1] = x @ emit
            a = np.zeros_like(node)
            a[:, 0] = start + node[:, 0]
            for t in range(1, size):
                new = np.logaddexp.reduce(a[:, t - 1, :, None] + move, axis=1) + node[:, t]
                a[:, t] = np.where(on[:, t, None], new, a[:, t - 1])
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            b = np.zeros_like(node)
            pairs = np.zeros((len(seqs), 2, 2))
            for t in range(size - 1, 0, -1):
                nxt = node[:, t] + b[:, t]
                p = np.exp(a[:, t - 1, :, None] + move + nxt[:, None, :] - z[:, None, None])
                pairs += np.where(on[:, t, None, None], p, 0)
                b[:, t - 1] = np.where(on[:, t, None],
                                       np.logaddexp.reduce(move[None] + nxt[:, None, :], axis=2), b[:, t])
            p1 = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * on
            truth = on * y[:, None]
            g_emit = np.einsum("i,it,itf->f", weight, truth - p1, x) - ridge * emit
            first = np.exp(a[:, 0] + b[:, 0] - z[:, None])
            g_start = (weight[:, None] * (np.eye(2)[y] - first)).sum(0) - ridge * start
            want = np.zeros((len(seqs), 2, 2))
            want[np.arange(len(seqs)), y, y] = on.sum(1) - 1
            g_move = (weight[:, None, None] * (want - pairs)).sum(0) - 0.05 * move
            for p, g, s in zip((emit, start, move), (g_emit, g_start, g_move), sums):
                s += g * g
                p += rate * g / np.sqrt(s)
        return LineCRF(emit, start, move)


def fit_line_crf(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                 train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> LineCRF:
    """Fitted on at most ``train_docs`` documents of each quality label, the
    first in the order of a hash of the id. Null ids and labels are left
    out; without both labels :meth:`LineCRF.default` is returned."""
    order = F.xxhash64(F.lit("line-crf"), F.col("doc_id"))
    lab = labels.select(F.col(id_col).alias("doc_id"), "quality").filter("doc_id is not null and quality in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picks = [lab.filter(f"quality = {q}").orderBy(order, "doc_id").limit(train_docs) for q in (0, 1)]
    picked = picks[0].union(picks[1])       # at most 2 * train_docs rows
    d = docs.select(F.col(id_col).alias("doc_id"), utf8(text).alias("b"))

    @F.pandas_udf("array<double>")
    def sample(ids: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for i, t in zip(ids, b):
            x = read_lines(t)[0]
            at = int(i) % max(1, len(x) - train_lines + 1)
            out.append(x[at:at + train_lines].ravel())
        return pd.Series(out)

    got = d.join(F.broadcast(picked), "doc_id").select(
        "doc_id", "quality", sample(F.crc32(F.col("doc_id").cast("string")), "b").alias("x"))
    got = got.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))       # one row for a picked id
    rows = sorted((r for r in got.collect() if r["x"]), key=lambda r: (str(r["doc_id"]), r["x"]))
    if {r["quality"] for r in rows} != {0, 1}:
        return LineCRF.default()
    return LineCRF.fit([np.array(r["x"]).reshape(-1, FEATURES) for r in rows], [1 - r["quality"] for r in rows])


KIND = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "n_lines long, content_lines long, content_share double, base_failed boolean, kept boolean")


def quality_column(crf: LineCRF, text: str = "text", min_share: float = MIN_SHARE,
                   min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT) -> Column:
    """Struct of the counts and the verdict for one text. Null and empty
    texts have no words and fail the base rules."""
    def judge(b: bytes) -> tuple:
        words = b.split()
        n = len(words)
        chars = len(b"".join(words).decode("utf-8", "surrogateescape"))
        x, counts, dup = read_lines(b)
        good = crf.decode(x) == 0 if len(x) else np.zeros(0, bool)
        share = float(counts[good].sum() / n) if n else 0.0
        rep = repeated_words(words)
        failed = n < min_words or 100 * rep > max_repeat_pct * n
        return (n, chars, len(b) - len(b.translate(None, SYMBOLS)), dup, rep, len(x), int(good.sum()), share,
                failed, not failed and share >= min_share)

    @F.pandas_udf(KIND)
    def run(b: pd.Series) -> pd.DataFrame:
        names = [part.split()[0] for part in KIND.split(", ")]
        return pd.DataFrame([judge(t) for t in b], columns=names)

    return run.asNondeterministic()(utf8(text))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
            min_share: float = MIN_SHARE, **fit) -> DataFrame:
    """One row per row of ``docs``: its id and the fields of
    :func:`quality_column`. Extra columns are ignored, repeated rows judged
    alike, an empty table gives an empty result."""
    crf = fit_line_crf(docs, labels, id_col, text, **fit)
    d = docs.select(F.col(id_col), quality_column(crf, text, min_share).alias("q"))
    return d.select(id_col, "q.*")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                 min_share: float = MIN_SHARE, **fit) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged."""
    crf = fit_line_crf(docs, labels, id_col, text, **fit)
    d = docs.select(F.struct(*docs.columns).alias("_row"), quality_column(crf, text, min_share).alias("_q"))
    return d.filter("_q.kept").select("_row.*")
