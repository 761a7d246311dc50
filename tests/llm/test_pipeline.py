"""The stages of the corpus pipeline, each on what the one before kept,
against brute-force versions on a small table."""

import random

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from blockwise.llm.common import cut


def write(spark, folder):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n // 12))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(4)]
    rows = [(i, text(rnd.randint(60, 200)), rnd.choice(["en", "de"]), rnd.choice(["s0", "s1", None])) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(8)]                       # exact copies
    rows += [(200 + i, text(60) + "\n" + items[i % 4][1], "en", "s1") for i in range(6)]
    rows += [(300 + i, "| a | b | ### $$$\n" * 30, "en", "s1") for i in range(6)]       # base rules
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, "short text", "en", "s0"), (None, text(80), "de", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows if r[0] is not None],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return items


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def order(x):
    return sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    items = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    (_, rules), (_, near), (_, bench), (_, mix), (_, shard) = corpus_pipeline.STAGES

    kept = cut(rules(spark, docs, folder))
    want = [r for r in pairs(docs) if not brute.quality_base(r[1])[-1]]
    assert kept.columns == names
    assert order(pairs(kept)) == order(want)        # every document that the base rules pass is clean here

    one = cut(near(spark, kept, folder))
    rows = order(pairs(kept))
    label = brute.classes([brute.fingerprint(t) for _, t in rows])
    first = {}
    for k, r in zip(label, rows):                   # ids ascend, null last
        first.setdefault(k, r)
    assert one.columns == names and order(pairs(one)) == order(first.values())
    assert one.filter("doc_id between 100 and 107").count() == 0

    clean = cut(bench(spark, one, folder))
    bad = {r[0] for r in brute.contamination(pairs(one), items) if r[-1]}
    assert bad == {200 + i for i in range(6)}
    assert clean.columns == names and order(pairs(clean)) == order(r for r in pairs(one) if r[0] not in bad)

    mixed = cut(mix(spark, clean, folder))
    assert mixed.columns == names
    sizes, taken, largest = {}, {}, {}
    for r in clean.collect():
        n = brute.n_words(r["text"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        largest[r["source"]] = max(largest.get(r["source"], 0), n)
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + brute.n_words(r["text"])
    for s, goal in brute.targets(sizes).items():
        assert abs(taken.get(s, 0) - goal) <= largest[s]
    assert mixed.groupBy("doc_id", "text").count().filter("count > 2").count() == 0

    out = cut(shard(spark, mixed, folder))
    assert out.count() == mixed.count()
    slots = out.groupBy("shard").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("n"))
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 for r in slots.collect())
    assert corpus_pipeline.run(spark, folder).count() == out.count()
