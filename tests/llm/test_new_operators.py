"""Hard negatives, personal data and spelling variants against brute force."""

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwise.llm import negatives, personal, spelling

VECTORS = "vec_id long, embedding array<double>, label int"


# ---- hard negatives

def mined(rows, positives=5, kept=3):
    """(anchor, positive, rank, negative, positive score, negative score)."""
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, v, y) in enumerate(rows):
        if i % 50:
            continue
        others = [(-dot(v, w), j, z) for m, (j, w, z) in enumerate(rows) if m != k]
        for s, j, _ in sorted(o for o in others if o[2] == y)[:positives]:
            fits = sorted(o for o in others if o[2] != y and -50 * s <= -100 * o[0] <= -95 * s)
            out += [(i, j, r + 1, o[1], -s, -o[0]) for r, o in enumerate(fits[:kept])]
    return sorted(out)


@pytest.mark.parametrize("block", [16 << 20, 64])
def test_hard_negatives(spark, block):
    rnd = random.Random(5)
    base = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in rnd.choice(base)], rnd.randint(0, 3)) for i in range(300)]
    rows += [(400, rows[50][1], 1), (350, base[0], 2), (350, base[0], 2), (350, base[1], 2)]       # ties, one id three times
    rows += [(500 + k, base[0], k % 2) for k in range(40)]                                         # one hot vector
    rows += [(None, base[0], 1), (600, None, 1), (650, base[0], None), (700, [1.0, None], 1), (701, [float("nan")], 1),
             (702, [float("inf")], 1), (750, [], 1), (751, [0.5], 1), (800, [-x for x in base[0]], 3)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"rid": F.lit(1), "score": F.lit("x"), "id": F.lit(0)})
    got = negatives.hard_negatives(df, F.col("id") % 50 == 0, block_bytes=block).collect()
    assert sorted(map(tuple, got)) == mined(rows)


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(df, F.lit(True)).count() == 0
    big = spark.createDataFrame([(0, [1e30], 1)], VECTORS)
    with pytest.raises(ValueError, match="2\\^55"):
        negatives.hard_negatives(big, F.lit(True))


@pytest.mark.parametrize("size,dims", [(3, 5), (2000, 64), (1 << 20, 9000)])
def test_residue_products(size, dims):
    rnd = np.random.default_rng(dims)
    a, b = rnd.integers(-size, size + 1, (7, dims)), rnd.integers(-size, size + 1, (11, dims))
    primes = negatives.primes_for(dims, dims * size * size)
    assert math.prod(primes) > 2 * dims * size * size and all(p % q for p in primes for q in range(2, int(p ** 0.5) + 1))
    assert all(min(dims, negatives.SLAB) * (p // 2) ** 2 <= negatives.EXACT for p in primes)
    got = negatives.ResidueMatrix(a, primes).scores(negatives.ResidueMatrix(b, primes))
    assert (got == a @ b.T).all()


# ---- personal data

def test_personal_base(spark):
    texts = [
        "mail a.b@c.example.org now, +1 (743) 555-3824 or 4992 4226 0209 0089 1", None, "", "x@y a@b.c_d@e.f.g @@ a@b..c",
        "1.2.3.4 256.1.1.1 0255.00.1.2 1.2.3.4.5.6.7.8 9.9.9", "4785380592391139 152.143.123.131", "+1 (826) 555-4081 190.137.223.204",
        "4111 1111 1111 1111 4111-1111-1111-1111", "+12345 +123456789012345678 +1 2 3 4 5 6 7 8 9", "1" * 30000, "1 " * 20000,
        "a@" + "a." * 20000, "é😀 é@é.fr mé@b.fr 😀 127.0.0.1😀+49 30 1234567", "+" * 5000 + "1" * 12, "(" * 5000 + "\n+1 555 444 333 2\n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit(1), "kind": F.lit("x"), "k": F.lit(2)})
    got = personal.personal_data(df).collect()
    want = [(i, *brute.personal_digest(t)) for i, t in rows]
    assert sorted(map(str, (tuple(r[:6]) for r in got))) == sorted(str(w[:6]) for w in want)
    by = {w[0]: w[6] for w in want}
    for r in got:       # base spans stay
        assert set(filter(None, by[r["doc_id"]].split(","))) <= set(r["spans"].split(","))
    assert personal.personal_data(df.limit(0)).count() == 0


def test_personal_candidates(spark):
    """Trees learn from checked spans; disguised ones are found, others left alone."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    card = lambda: next(c for c in iter(lambda: f"4{rnd.randrange(10 ** 15):015d}", 0) if brute.luhn(c))
    made = [lambda: f"{word()}@{word()}.com", lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)), card,
            lambda: f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}",
            lambda: f"order {rnd.randint(10, 10 ** 7)}", lambda: f"version {rnd.randint(300, 900)}.{rnd.randint(0, 9)}.1.2"]
    rows = [(i, f"{word()} {word()} {made[i % len(made)]()} {word()}") for i in range(1200)]
    plants = {2000: "call (743) 555-3824 now", 2001: "write bob [at] mail [dot] com please", 2002: "host 117[.]20[.]133[.]41 is down",
              2003: "then +1 (826) 555-4081 190.137.223.204 came", 2004: "nothing 12 to 2023-01-15 see"}
    df = spark.createDataFrame(rows + list(plants.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal.personal_data(df).collect()}
    for i, (kind, x) in {2001: ("email", "bob [at] mail [dot] com"), 2002: ("ip", "117[.]20[.]133[.]41"),
                         2003: ("phone", "+1 (826) 555-4081")}.items():
        at = plants[i].index(x)
        assert f"{kind}:{at}:{at + len(x)}" in got[i]["spans"].split(","), (i, got[i])
    assert got[2004]["spans"] == "" and sum(got[i]["n_added"] for i, _ in rows) < 12


def test_personal_learns_from_every_span(spark, monkeypatch):
    """No base span outside the calibration part is left out of the trees, and
    no word before a span out of the odds, however rare."""
    n = 48000
    i = F.col("id")
    base = spark.range(n).select(
        i.alias("rid"), F.lit(1).alias("k"), F.lit("ip").alias("kind"), F.lit(0).alias("start"), F.lit(9).alias("stop"),
        F.concat(F.lit("1.2.3."), i.cast("string")).alias("x"),
        F.concat(F.translate((i % 3000).cast("string"), "0123456789", "abcdefghij"), F.lit(" ")).alias("before"),
        F.lit("").alias("after"), F.lit(True).alias("base"), (i % 2 == 0).alias("valid"))
    loose = base.limit(5).withColumns({"base": F.lit(False), "valid": F.lit(True)})
    seen, fit = [], personal.GBTClassifier.fit
    monkeypatch.setattr(personal.GBTClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    assert personal.score_spans(base.union(loose), trees=1, depth=1).count() == 5
    held = base.filter(F.pmod(F.xxhash64("x"), F.lit(5)) == 0).count()
    assert seen == [n - held]
    train = personal._features(base).withColumns({"y": F.col("valid").cast("int"), "part": F.col("rid") % 4 + 1})
    odds = {r["cue"]: r["odds"] for r in personal._cue_odds(train, 0.5).collect()}
    assert len(odds) == 3000
    own = range(1, n, 3000)
    for part, got in enumerate(odds["b"]):
        rest = [r for r in own if part == 0 or r % 4 + 1 != part]
        valid = sum(r % 2 == 0 for r in rest)
        assert abs(got - math.log((valid + 0.5) / (len(rest) - valid + 0.5))) < 1e-9


# ---- spelling variants

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def variants(rows):
    n = Counter()
    for i, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in t).split():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out, form = {}, {}
    for w in n:
        around = [x for x in n if near(w, x)]
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [w, form[w], None, n[w], len(around), n[form[w]] if form[w] else None]
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out[w][2] = r
    return sorted(map(str, map(tuple, out.values())))


@pytest.mark.parametrize("parts", [7, 3])
def test_spelling(spark, parts):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abé×") for _ in range(rnd.randint(4, 8))) for _ in range(150)] + ["letter", "aaaaaa", "aaaaaaa", "ÉCOLE"]
    rows = [(i, " ".join(rnd.choice(words[:rnd.randint(1, len(words))]) for _ in range(rnd.randint(0, 120)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "123 !? 中文"), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]),
             (203, "Letter-lettre " * 3000), (204, "lettr " * 4 + "letted " * 9 + "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "key": F.lit(2)})
    got = spelling.spelling_groups(df, parts=parts).collect()
    assert sorted(str(tuple(r)) for r in got) == variants(rows)
    assert spelling.spelling_groups(df.limit(0)).count() == 0
