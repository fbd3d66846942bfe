"""Streams over the given tables: deletions in any order, bounded refreshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.folders import folder
from ..streaming import tombstones
from .registry import query
from .views import table


@query("st4_standing_by_stream", """WITH e AS (SELECT user_id::VARCHAR AS key, event_type = 'error' AS gone, ts AS t, event_type AS value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
k AS (SELECT key, max(t) FILTER (NOT gone) AS record_at, max(t) FILTER (gone) AS gone_at FROM e GROUP BY key),
v AS (SELECT e.key, max(value) AS value FROM e JOIN k ON e.key = k.key AND NOT gone AND t = record_at GROUP BY e.key)
SELECT key, CASE WHEN gone_at >= record_at THEN NULL ELSE value END AS value, coalesce(gone_at >= record_at, false) AS is_deleted FROM k JOIN v USING (key)""")
def standing_by_stream(spark, sf):
    """Errors delete, all else writes; the events come in four batches that have nothing to do with their times."""
    landed, out = folder(spark, "landed-events"), folder(spark, "standing")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", "deletion").otherwise("record").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("value"), F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("b"))
    schema = e.drop("b").withColumn("arrived", F.current_timestamp()).schema
    for k in range(4):  # each call drains what has landed since, with one checkpoint
        e.where(F.col("b") == k).drop("b").withColumn("arrived", F.lit(f"2030-01-01 0{k}:00:00").cast("timestamp")).write.mode("append").parquet(landed)
        # a batch that comes again writes its own folder anew
        put = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part={n}")
        changes = tombstones.settled(spark.readStream.schema(schema).parquet(landed))
        changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}-mark").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("value", "is_deleted"), "batch").alias("s"))
    return told.select("key", "s.value", "s.is_deleted")


@query("st6_due_refreshes", "SELECT doc_id FROM (SELECT doc_id, coalesce(sha256(text), '') AS h FROM documents) WHERE doc_id % 2 = 1 OR doc_id % 3 = 0 ORDER BY doc_id LIMIT 500")
def due_refreshes(spark, sf):
    """The next 500 documents whose vector is missing (odd ids) or of an older text (every third)."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("h"))
    known = d.where("doc_id % 2 = 0").withColumn("h", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("h")))
    return tombstones.due(d, known, key="doc_id", hashed="h").select("doc_id")
