"""Reports of imports and runs that keep a bounded part of each group, and what changed between two assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What of a quality report counts as a change of it.
REPORTED = ("final_score", "grade", "missing_fields", "validation_errors", "warnings", "recommendations", "ruleset_version")


def first_of(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; each task keeps n rows a group before anything is moved, so no group comes together whole."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)
    return ranked


def import_report(rows: DataFrame, stored_titles: DataFrame, *, sample: int = 20, most_errors: int = 100) -> DataFrame:
    """(run, seen, valid, invalid, active, deleted, likely_creates, sample, errors) of rows (run, record_index, record_id, title, key_title, is_deleted, error).

    A row with an error is invalid; an active valid row whose title isn't stored (key_title) is likely a new one.
    sample: the ids of the first valid rows; errors: the first (record_index, message), each in the order of
    the file. Nulls of run are one run; a run without errors has an empty list.
    """
    known = stored_titles.select("key_title").where("key_title is not null").distinct().withColumn("_known", F.lit(True))
    r = rows.join(known, "key_title", "left").withColumn("_valid", F.col("error").isNull())
    fresh = F.col("_valid") & ~F.coalesce("is_deleted", F.lit(False)) & F.col("_known").isNull()
    live = F.col("_valid") & ~F.coalesce("is_deleted", F.lit(False))
    counts = r.groupBy("run").agg(
        F.count("*").alias("seen"), F.count_if("_valid").alias("valid"), F.count_if(~F.col("_valid")).alias("invalid"), F.count_if(live).alias("active"), F.count_if(F.col("_valid") & F.coalesce("is_deleted", F.lit(False))).alias("deleted"), F.count_if(fresh).alias("likely_creates"),
    )
    order = [F.col("record_index"), F.col("record_id")]
    some = first_of(rows.where("error is null"), ["run"], order, sample).groupBy(F.col("run").alias("_s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "record_id"))), lambda x: x["record_id"]).alias("sample"))
    bad = first_of(rows.where("error is not null"), ["run"], order, most_errors).groupBy(F.col("run").alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "record_index", F.col("error").alias("message")))), lambda x: F.struct(x["record_index"].alias("record_index"), x["message"].alias("message"))).alias("errors"))
    out = counts.join(some, F.col("run").eqNullSafe(F.col("_s")), "left").join(bad, F.col("run").eqNullSafe(F.col("_b")), "left").drop("_s", "_b")
    return out.withColumns({"sample": F.coalesce("sample", F.array().cast(some.schema["sample"].dataType)), "errors": F.coalesce("errors", F.array().cast(bad.schema["errors"].dataType))})


def changed_reports(old: DataFrame, new: DataFrame, key: str, fields: tuple[str, ...] = REPORTED) -> DataFrame:
    """(key, changed): of each new report the fields that differ from the old one's, all of them where there is none. Lists are compared as they are ordered; unchanged reports are left out."""
    both = new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields]).join(old.select(key, *fields, F.lit(True).alias("_old")), key, "left")
    differs = [F.when(F.col("_old").isNull() | ~F.col(f).eqNullSafe(F.col(f"_n_{f}")), f) for f in fields]
    return both.select(key, F.array_compact(F.array(*differs)).alias("changed")).where(F.size("changed") > 0)
