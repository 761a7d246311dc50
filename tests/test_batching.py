from collections import Counter

from pyspark.sql import functions as F

from blockwise.operators import batching as B


def blocks(spark, n):
    return spark.range(n).select(F.lit("train").alias("split"), F.col("id").alias("block_id"))


def test_epochs_are_permutations_with_drop_last(spark):
    r = B.assign_batches(B.shuffle_blocks(blocks(spark, 103), 42, epochs=3), 10).collect()
    for e in range(3):
        ids = [x.block_id for x in r if x.epoch == e]
        assert len(ids) == 100 and len(set(ids)) == 100       # 3 dropped, none twice
        per_batch = Counter(x.batch_id for x in r if x.epoch == e)
        assert set(per_batch.values()) == {10} and set(per_batch) == set(range(10))
    e0 = sorted((x.batch_id, x.slot, x.block_id) for x in r if x.epoch == 0)
    e1 = sorted((x.batch_id, x.slot, x.block_id) for x in r if x.epoch == 1)
    assert e0 != e1


def test_shuffle_is_seeded_and_partition_free(spark):
    a = B.shuffle_blocks(blocks(spark, 50), 7, epochs=1).orderBy("rank").collect()
    b = B.shuffle_blocks(blocks(spark, 50).repartition(7), 7, epochs=1).orderBy("rank").collect()
    assert [x.block_id for x in a] == [x.block_id for x in b]
    c = B.shuffle_blocks(blocks(spark, 50), 8, epochs=1).orderBy("rank").collect()
    assert [x.block_id for x in a] != [x.block_id for x in c]


def test_schedule_stops_mid_epoch(spark):
    s = B.schedule(blocks(spark, 45), 10, 4, 42).collect()     # 11 batches per epoch
    steps = sorted({x.step for x in s})
    assert steps == list(range(10))
    assert all(x.epoch == 0 for x in s)
    s2 = B.schedule(blocks(spark, 45), 25, 4, 42).collect()
    ep = {x.step: x.epoch for x in s2}
    assert ep[10] == 0 and ep[11] == 1 and ep[22] == 2 and len(s2) == 25 * 4


def test_eval_batches_first_m(spark):
    e = B.eval_batches(blocks(spark, 45), 4, 3).collect()
    assert sorted(x.block_id for x in e) == list(range(12))
    e = B.eval_batches(blocks(spark, 45), 4, 50).collect()
    assert len(e) == 44
