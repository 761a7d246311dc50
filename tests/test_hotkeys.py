"""Heavy keys by sketch and Bloom-filtered joins against plain joins."""

from pyspark.sql import functions as F

from blockwise.operators import hotkeys as H


def test_cold_branch_has_no_hot_key(spark):
    """The last id (an end marker) has a third of the rows, one hot id has no row in the table, nulls are many."""
    n, k = 60_000, 8
    key = (F.when(F.col("id") % 3 == 0, 999_999).when(F.col("id") % 10 == 1, 5).when(F.col("id") % 20 == 2, None)
           .otherwise(1000 + F.col("id") % 5000).cast("long"))
    rows = spark.range(n).select("id", key.alias("key"))
    table = spark.range(6000).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("v")).filter("key <> 5")
    table = table.union(spark.createDataFrame([(999_999, "end")], "key long, v string"))
    hot = {r["key"] for r in H.heavy_keys(rows, "key", k).collect()}
    assert {999_999, 5} <= hot and len(hot) <= k and None not in hot
    cold = rows.filter(~F.col("key").isin(list(hot))).groupBy("key").count().agg(F.max("count")).first()[0]
    assert cold <= n / k
    got = H.hot_cold_join(rows, table, "key", "v", k)
    want = rows.join(table, "key", "left").select("id", "key", "v")
    assert got.count() == n and got.select("id", "key", "v").exceptAll(want).isEmpty()
    assert H.hot_cold_join(rows.limit(0), table, "key", "v", k).count() == 0


def test_bloom_filter_keeps_every_match(spark):
    rows = spark.range(0, 4000, 4).select(F.concat(F.lit("t"), "id").alias("a"), (F.col("id") % 7).alias("b"))
    rows = rows.union(rows).union(spark.createDataFrame([(None, 1)], "a string, b long"))
    table = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("a"), (F.col("id") % 7).alias("b"), "id")
    kept = H.keep_possible(table, rows, ["a", "b"], 1 << 16)
    found = table.join(rows.distinct(), ["a", "b"], "left_semi")
    assert found.exceptAll(kept.select("a", "b", "id")).isEmpty() and found.count() == 1000
    assert kept.count() < 1200          # 19000 others, a few false positives
    assert H.keep_possible(table, rows.limit(0), ["a", "b"], 1 << 16).count() == 0


def test_known_heavy_keys_join_without_a_write(spark, monkeypatch):
    """A null key and a heavy key without a row stay; the rows are not written."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 9 == 1, 2).when(
        F.col("id") % 9 == 2, None).otherwise(F.col("id") % 100).cast("long").alias("key"))
    table = spark.range(80).filter("id <> 2").select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("v"))
    monkeypatch.setattr(H, "cut", None)
    got = H.known_hot_join(rows, table, "key", "v", F.col("key") < 3)
    want = rows.join(table, "key", "left").select("id", "key", "v")
    assert got.count() == 3000 and got.select("id", "key", "v").exceptAll(want).isEmpty()
