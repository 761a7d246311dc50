"""Ordered scans against plain Python: sparse and crowded keys, hot and null
partitions, ties, several levels of totals."""

import random

import pytest
from pyspark.sql import functions as F

from blockwise.operators import prefix as P


def rows_of(n, rng):
    out = [(rng.choice(["hot", "hot", "a", None]), rng.choice([rng.randint(0, 50), rng.randint(0, 10 ** 15)]) * 1000 + i,
            rng.choice([None, rng.randint(-9, 9)])) for i in range(n)]
    return out + [("one", 5, 3)]


@pytest.mark.parametrize("fan", [2, 3, 1024])
@pytest.mark.parametrize("inclusive", [True, False])
def test_scan_matches_loop(spark, fan, inclusive):
    rows = rows_of(500, random.Random(fan))
    df = spark.createDataFrame(rows, "k string, o long, v int")
    v = F.col("v")
    got = {(r.k, r.o): r for r in P.ordered_scan(df, ["o"], {"s": (P.SUM, v), "m": (P.MIN, v), "l": (P.LAST, v)}, ["k"],
                                                 inclusive=inclusive, whole={"t": "s"}, fan=fan).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        s = m = last = None
        own = sorted((o, v) for k, o, v in rows if k == key)
        total = [v for _, v in own if v is not None]
        for o, v in own:
            before = (s, m, last)
            if v is not None:
                s, m, last = (s or 0) + v, v if m is None else min(m, v), v
            g = got[(key, o)]
            assert (g.s, g.m, g.l) == ((s, m, last) if inclusive else before)
            assert g.t == (sum(total) if total else None)


@pytest.mark.parametrize("fan", [2, 1024])
def test_rank_without_partition(spark, fan):
    rng = random.Random(1)
    ids = rng.sample(range(10 ** 17), 300) + list(range(300))
    df = spark.createDataFrame([(i,) for i in ids], "o long")
    got = P.ranged_rank(df, [F.col("o").desc()], fan=fan).collect()
    assert [r.o for r in sorted(got, key=lambda r: r["rank"])] == sorted(ids, reverse=True)
    assert sorted(r["rank"] for r in got) == list(range(600))
    assert P.ranged_rank(df.limit(0), ["o"]).count() == 0


def test_levels_of_totals(spark):
    """64 totals, four at a time: three levels."""
    n, fan = 64, 4
    totals = spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("_rng"), F.lit(1).alias("s"))
    got = P.carried(totals, ["k"], {"s": P.SUM}, n, fan)
    assert {r["_rng"]: r.s for r in got.collect()} == {i: i or None for i in range(n)}
