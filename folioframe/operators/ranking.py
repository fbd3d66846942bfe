"""Windows: latest, first and best rows, caps, positions and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; rank keeps their number. The engine cuts groups before it shuffles them."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def best(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row a group, that with the least order, by a grouped minimum: no group is sorted or gathered."""
    chosen = df.groupBy(*keys).agg(F.min(F.struct(order.alias("_o"), *[F.col(c) for c in columns])).alias("_b"))
    return chosen.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in columns])


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of every field that differs, nulls told apart from values."""
    both = old.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in fields]).join(new.select(key, *[F.col(c).cast("string").alias(f"n_{c}") for c in fields]), key)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value")) for c in fields])
    return both.select(key, F.explode(F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))).alias("c")).select(key, "c.*")


def failure_streak(jobs: DataFrame, key: str, time: str, status: str) -> DataFrame:
    """(key, last_success, failures): the last success and how many failed since."""
    last = jobs.groupBy(key).agg(F.max(F.when(F.col(status) == "completed", F.col(time))).alias("last_success"))
    failed = jobs.where(F.col(status) == "failed").select(key, F.col(time).alias("_t"))
    return last.join(failed, key, "left").groupBy(key).agg(F.first("last_success").alias("last_success"), F.count_if(F.col("_t").isNotNull() & (F.col("last_success").isNull() | (F.col("_t") > F.col("last_success")))).alias("failures"))
