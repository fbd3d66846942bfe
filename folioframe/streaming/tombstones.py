"""Deletions that may come before or after what they delete, and refreshes of so many rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, value string, is_deleted boolean, at timestamp, waited boolean"
#: Of a key: its newest record and newest deletion (microseconds, 0 for none), and the record's value.
STATE = "value string, record_at long, gone_at long, told boolean"


def settled(events: DataFrame, patience: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """A stream of (key string, kind: record or deletion, at timestamp, value string, arrived timestamp) to the standing of each key as it changes.

    The newest event of a key decides, a deletion before a record of the same time; in whatever order and batches they
    come, the last row of a key is the same. A deletion without a record says nothing at first: it waits for
    its record, and when arrivals are `patience` past its own it is given out by itself (waited). Events without key,
    time or arrival are left out. No event is too old, for its own time is not the stream's clock: that is when it was landed,
    which must not go back by more than `lateness`.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, record_at, gone_at, told = state.get if state.exists else (None, 0, 0, False)
        if state.hasTimedOut:
            state.update((value, record_at, gone_at, True))
            yield pd.DataFrame([(key[0], None, True, pd.Timestamp(gone_at, unit="us"), True)], columns=["key", "value", "is_deleted", "at", "waited"])
            return
        before, last = (value, record_at, gone_at), 0
        for b in batches:
            for kind, at, v, came in zip(b["kind"], b["at"].astype("datetime64[us]").astype("int64"), b["value"], b["arrived"].astype("datetime64[ms]").astype("int64")):
                last = max(last, came)
                v = None if pd.isna(v) else v
                if kind == "deletion":
                    gone_at = max(gone_at, at)
                elif (at, v or "") >= (record_at, value or ""):  # of two records of one time the greater value stands
                    record_at, value = at, v
        gone = gone_at >= record_at
        if record_at and before != (value, record_at, gone_at):
            told = True
            yield pd.DataFrame([(key[0], None if gone else value, gone, pd.Timestamp(max(record_at, gone_at), unit="us"), False)], columns=["key", "value", "is_deleted", "at", "waited"])
        state.update((value, int(record_at), int(gone_at), told))
        if not record_at and not told:
            state.setTimeoutTimestamp(max(int(last) + wait, state.getCurrentWatermarkMs() + 1))

    own = events.where("key is not null and at is not null and arrived is not null").select("key", "kind", "at", "value", "arrived").withWatermark("arrived", lateness)
    return own.groupBy("key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def due(rows: DataFrame, embeddings: DataFrame, *, key: str, hashed: str, limit: int = 500) -> DataFrame:
    """Of rows (key, content hash, ...) the first `limit` by key whose vector is missing or of another content: a bounded sort in each task."""
    known = embeddings.select(F.col(key).alias("_k"), F.col(hashed).alias("_h"))
    stale = rows.join(known, F.col(key) == F.col("_k"), "left").where(~F.col(hashed).eqNullSafe(F.col("_h"))).drop("_k", "_h")
    return stale.orderBy(key).limit(limit)


def refreshed(ticks: DataFrame, rows: Callable[[], DataFrame], path: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame], *, key: str, hashed: str, limit: int = 500):
    """For each micro-batch of ticks (an hour each, as its trigger says) encodes what is due, at most `limit` rows, and appends it to `path`.

    The newest version of a key is its vector. A batch that comes again after a failure overwrites what it wrote.
    """

    def tick(_: DataFrame, batch: int) -> None:
        spark = ticks.sparkSession
        schema = encode(rows().limit(0)).withColumn("version", F.lit(0).cast("long")).schema
        # versions are folders: this batch's own is not among what is known
        known = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).where(F.col("version") < batch)
        newest = known.groupBy(key).agg(F.max_by(hashed, "version").alias(hashed))
        encode(due(rows(), newest, key=key, hashed=hashed, limit=limit)).withColumn("version", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
