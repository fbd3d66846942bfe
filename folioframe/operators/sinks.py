"""Writers: history, quarantine, exports, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def append_history(changes: DataFrame, path: str, at: str) -> None:
    """Adds field changes to the history, dated by the run, so that reruns can be told apart."""
    changes.withColumn("changed_at", F.lit(at).cast("timestamp")).write.mode("append").parquet(path)


def split_errors(rows: DataFrame, path: str, error: str = "error") -> DataFrame:
    """Writes rows with an error to quarantine as JSON and returns the others."""
    rows.where(F.col(error).isNotNull()).write.mode("overwrite").json(path)
    return rows.where(F.col(error).isNull()).drop(error)


def exported(cited: DataFrame, style: str, path: str) -> None:
    """Unique cited sources as BibTeX or RIS text: the place of the first mention, the values of the last.

    cited: (position, key, title, authors, year, doi, url).
    """
    rows = cited.groupBy("key").agg(F.min("position").alias("at"), F.max_by(F.struct("title", "authors", "year", "doi", "url"), "position").alias("c"))
    text = S.citation(style, F.col("c.authors"), F.col("c.title"), F.col("c.year"), F.col("c.doi"), F.col("c.url"))
    rows.orderBy("at").select(text.alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")


def exported_records(rows: DataFrame, path: str, key: str | None = None, order: str = "position") -> None:
    """Records as lines of JSON; with a key only the first of each, rows without one all."""
    if key:
        place = F.struct(order)
        least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias("_least"))
        rows = rows.join(least, key, "left").where(F.col("_least").isNull() | (place == F.col("_least"))).drop("_least")
    rows.write.mode("overwrite").json(path)


def registry(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Document registry: a new row's value wins unless it is empty."""
    n = new.select(key, *[S.clean(F.col(f)).alias(f"_n_{f}") for f in fields])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(f"_n_{f}", f).alias(f) for f in fields])


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(F.least(F.lit(100.0), done * 100.0 / total), 2)).otherwise(0.0)


def summary(rows: DataFrame, status: str, size: str) -> DataFrame:
    """One row a status: how many, and how many bytes."""
    return rows.groupBy(status).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
