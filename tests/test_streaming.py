"""Sinks of streams: batches that come again change nothing, buckets that a batch doesn't touch stay."""

from folioframe.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_repeated_batches_change_nothing(spark, tmp_path):
    a, b = (spark.createDataFrame(x, "k int, at int, v string") for x in ([(1, 5, "a"), (2, 5, "b"), (2, 4, "old")], [(2, 6, "c"), (3, 1, "d"), (1, 4, "late")]))
    path = f"{tmp_path}/state"
    write = ingest.upsert_sink(path, "k", "at", buckets=8)
    assert rows(ingest.current_state(spark, path, a.schema)) == []
    write(a.limit(0), 0)
    for batch, n in ((a, 1), (a, 1), (b, 2), (b, 2)):
        write(batch, n)
    assert rows(ingest.current_state(spark, path, a.schema)) == [(1, 5, "a"), (2, 6, "c"), (3, 1, "d")]
    write(spark.createDataFrame([(9, 1, "z")], a.schema), 3)
    assert rows(ingest.current_state(spark, path, a.schema)) == [(1, 5, "a"), (2, 6, "c"), (3, 1, "d"), (9, 1, "z")]

    path = f"{tmp_path}/all"
    for batch, n in ((a, 0), (b, 1), (b, 1)):
        ingest.appended(path)(batch, n)
    assert spark.read.parquet(path).count() == 6

    path = f"{tmp_path}/first"
    write = ingest.first_seen(path, ["k"])
    for batch, n in ((a, 0), (b, 1), (a, 0), (b, 1), (a, 2)):
        write(batch, n)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
