"""Incremental ingest: the batch operators over micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def landed(spark: SparkSession, path: str, schema, most_files: int = 1000) -> DataFrame:
    """New Parquet files of a landing place, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Works off what has landed and stops; the checkpoint is the high-water mark of the next call."""
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each batch once: one that comes again writes its own place again."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def first_seen(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds the rows whose keys no earlier batch had, one a key.

    What was seen lies in the table itself, not in the stream's memory, however long it runs; a batch
    that comes again is compared with the batches before it and writes its own place again.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(keys)
        if (seen := stored(batch.sparkSession, path)) is not None:
            new = new.join(seen.where(F.col("batch") < number).select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What has been written to path, None before anything was."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.parquet(path) if there else None


def event_counts(stream: DataFrame, time: str, kind: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events by window and kind, late ones within `delay` included."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def latest_state(batch: DataFrame, stored: DataFrame | None, key: str, time: str) -> DataFrame:
    """The newest row of each key over what is stored and a batch: tombstones and records may come in any order."""
    both = batch if stored is None else stored.unionByName(batch)
    return both.groupBy(key).agg(F.max(F.struct(time, *[c for c in batch.columns if c not in (key, time)])).alias("r")).select(key, "r.*").select(batch.columns)


def current_state(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The rows of upsert_sink's table: each bucket's newest version (before a batch, if one is given); empty if there is none."""
    all_ = stored(spark, path)
    if all_ is None:
        return spark.createDataFrame([], schema)
    versions = all_ if before is None else all_.where(F.col("batch") < before)
    newest = versions.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return versions.join(F.broadcast(newest), ["bucket", "batch"], "left_semi").select(*schema.names)


def upsert_sink(path: str, key: str, time: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key.

    Keys are dealt over buckets; a batch writes a new version of the buckets that it touches and no other
    (`buckets` values at most come to the driver). A repeated batch reads the versions before its own and
    writes its own again, so it changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
        if not touched:
            return
        before = current_state(spark, path, batch.schema, number).where(bucket.isin(touched))
        new = latest_state(batch, before, key, time).withColumn("bucket", bucket)
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return write
