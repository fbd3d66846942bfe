"""Deletions in any order, and refreshes tick by tick."""

import datetime
import itertools
import os

from pyspark.sql import functions as F

from folioframe.streaming import tombstones as T

AT = datetime.datetime(2024, 1, 1)
SCHEMA = "key string, kind string, at timestamp, value string, arrived timestamp"


def batches(spark, folder, groups, step=1):
    """One file a micro-batch, in order of their names and times."""
    os.makedirs(folder)
    for k, rows in enumerate(groups):
        spark.createDataFrame([(i, kind, AT + datetime.timedelta(hours=h) if h is not None else None, v, AT + datetime.timedelta(hours=step * k)) for i, kind, h, v in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/.{k}")
        name = next(f for f in os.listdir(f"{folder}/.{k}") if f.startswith("part-"))
        os.rename(f"{folder}/.{k}/{name}", f"{folder}/b{k:03d}.parquet")
        os.utime(f"{folder}/b{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def more(spark, tmp_path, name, rows):
    """One file more in a folder that a stream reads."""
    spark.createDataFrame([(i, kind, AT + datetime.timedelta(hours=h), v, AT + datetime.timedelta(hours=99)) for i, kind, h, v in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/more-{name}")
    file = next(f for f in os.listdir(f"{tmp_path}/more-{name}") if f.startswith("part-"))
    os.rename(f"{tmp_path}/more-{name}/{file}", f"{tmp_path}/{name}/b999.parquet")


def standing(spark, tmp_path, name, groups, **options):
    rows = []
    stream = T.settled(batches(spark, f"{tmp_path}/{name}", groups), **options)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend((n, r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return rows


def test_any_order_gives_one_standing(spark, tmp_path):
    events = [("a", "record", 1, "v1"), ("a", "deletion", 2, None), ("a", "record", 3, "v3"), ("b", "deletion", 2, None), ("b", "record", 1, "w")]
    for n, order in enumerate([events, events[::-1], [events[k] for k in (2, 3, 1, 4, 0)]]):
        last = {r.key: (r.value, r.is_deleted) for _, r in standing(spark, tmp_path, f"o{n}", [[e] for e in order] + [[(None, "record", 1, "x"), ("c", "record", None, "x")]])}
        assert last == {"a": ("v3", False), "b": (None, True)}
    for n, cut in enumerate(itertools.islice(itertools.permutations(range(3)), 2)):  # and in one batch
        assert {r.key: (r.value, r.is_deleted) for _, r in standing(spark, tmp_path, f"p{n}", [[events[:3][k] for k in cut]])} == {"a": ("v3", False)}


def test_a_deletion_waits_and_then_speaks(spark, tmp_path):
    """Files land every ten hours: that is the clock."""
    groups = [[("lost", "deletion", 0, None), ("late", "deletion", 0, None)], [("late", "record", -1, "x")], [("tick", "record", 0, "t")], [("tick", "record", 1, "t")], [("tick", "record", 2, "t")]]
    rows = []
    q = T.settled(batches(spark, f"{tmp_path}/w", groups, 10), patience="1 day").writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend((n, r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/w-c").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    assert [(r.is_deleted, r.waited) for _, r in rows if r.key == "late"] == [(True, False)]
    lost = [(n, r.is_deleted, r.waited) for n, r in rows if r.key == "lost"]
    assert len(lost) == 1 and lost[0][0] >= 3 and lost[0][1:] == (True, True)


def test_refreshes_of_a_bounded_number(spark, tmp_path):
    rows = lambda: spark.range(12).select(F.col("id"), F.sha2(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(changed[0])), 256).alias("h"))
    changed, path = [""], f"{tmp_path}/vectors"
    os.makedirs(path)
    encode = lambda df: df.withColumn("embedding", F.array(F.length("h").cast("float")))
    ticks = batches(spark, f"{tmp_path}/ticks", [[("t", "record", k, None)] for k in range(3)])
    run = lambda: T.refreshed(ticks, rows, path, f"{tmp_path}/check", encode, key="id", hashed="h", limit=5).trigger(availableNow=True).start().awaitTermination(240)
    run()
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(path).groupBy("batch").count().collect()}
    assert sizes == {0: 5, 1: 5, 2: 2}
    changed[0] = "!"
    more(spark, tmp_path, "ticks", [("t", "record", 9, None)])
    run()
    assert spark.read.parquet(path).where("batch = 3").count() == 5
