"""Chains of pages: which follow from the first by their tokens, and how each chain ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import folder


def followed(pages: DataFrame, path: str | None = None) -> DataFrame:
    """pages (source, page, asked, token, ...) with state and root.

    A page was asked for with a token (the first with none) and gives the next one. Each page points to the
    one that gave its token (of several the least), and pointers are doubled until they stand at a page that
    nothing points from: n pages in a row take log2(n) joins, each of one row a page. State: followed (the
    root was asked for without a token), orphan (no landed page gave the root's token), cycle (there is no
    root), again (another page was asked for with the same token before). Rounds are written to `path`, or to a new shared folder.
    """
    spark = pages.sparkSession
    path = path or folder(spark, "chains")
    key = ["source", "page"]

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    given = F.nullif(F.trim("token"), F.lit(""))
    p = pages.withColumns({"asked": F.nullif(F.trim("asked"), F.lit("")), "token": given})
    lead = p.groupBy("source", F.coalesce("asked", F.lit("")).alias("_asked")).agg(F.min("page").alias("page"))
    p = stored(p.join(lead.select(*key, F.lit(True).alias("_lead")), key, "left").withColumn("_lead", F.coalesce("_lead", F.lit(False))), "pages")
    givers = p.where("_lead and token is not null").groupBy("source", F.col("token").alias("asked")).agg(F.min("page").alias("up"))
    at = p.where("_lead").join(givers, ["source", "asked"], "left").select(*key, "up", F.when(F.col("up").isNull(), F.col("page")).alias("root"))
    done, open_ = stored(at.where("root is not null"), "done-0"), stored(at.where("root is null"), "open-0")
    left, rounds = open_.count(), 0
    while left:
        # Only pages without a root move, and no two of a chain stand at the same page: no key is hot.
        rounds += 1
        every = done.select("source", F.col("page").alias("up"), F.lit(None).cast(open_.schema["up"].dataType).alias("_up"), "root").unionByName(open_.select("source", F.col("page").alias("up"), F.col("up").alias("_up"), F.lit(None).cast(done.schema["root"].dataType).alias("root")))
        moved = stored(open_.drop("root").join(every, ["source", "up"]).select(*key, F.col("_up").alias("up"), "root"), f"moved-{rounds}")
        done = done.unionByName(moved.where("root is not null").select(done.columns))
        open_ = moved.where("root is null")
        now = open_.count()
        if now == left and 2**rounds > left:  # a chain of them all would have ended: they go round
            break
        left = now
    roots = done.select(*key, "root").join(p.select("source", F.col("page").alias("root"), F.col("asked").alias("_of")), ["source", "root"])
    known = roots.select(*key, "root", F.when(F.col("_of").isNull(), "followed").otherwise("orphan").alias("state")).unionByName(open_.select(*key, F.lit(None).cast(done.schema["root"].dataType).alias("root"), F.lit("cycle").alias("state")))
    return p.join(known, key, "left").withColumn("state", F.when(F.col("_lead"), F.col("state")).otherwise("again")).drop("_lead")


def chain_report(pages: DataFrame, as_of: str, path: str | None = None) -> DataFrame:
    """(source, pages, followed, records, promised, ended) of pages with source, page, asked, token, expires, records and complete_size.

    ended: complete (the last page that follows from the first gives no token, and all that was promised has come), short
    (less has come), repeated (its token was given before), expired (its token ran out before `as_of`), gap (no page
    of its token has landed), none (the first page hasn't landed).
    """
    s = followed(pages, path)
    live = s.where("state = 'followed'")
    givers = live.where("token is not null").groupBy("source", "token").agg(F.min("page").alias("_giver"))
    landed = s.where("asked is not null and state <> 'again'").select("source", F.col("asked").alias("token"), F.lit(True).alias("_landed"))
    ends = live.join(givers, ["source", "token"], "left").join(landed, ["source", "token"], "left")
    # The last page of a chain: it gives no token, or one that leads to no page of its own.
    ends = ends.where(F.col("token").isNull() | (F.col("_giver") != F.col("page")) | F.col("_landed").isNull() | (F.col("token") == F.col("asked")))
    kind = F.when(F.col("token").isNull(), "end").when(F.col("_landed").isNotNull(), "repeated").when(F.col("expires") < F.lit(as_of).cast("timestamp"), "expired").otherwise("gap")
    last = ends.groupBy("source").agg(F.max_by(kind, "page").alias("_kind"))
    counts = s.groupBy("source").agg(
        F.count("*").alias("pages"), F.count_if(F.col("state") == "followed").alias("followed"), F.coalesce(F.sum(F.when(F.col("state") == "followed", F.col("records"))), F.lit(0)).cast("long").alias("records"), F.max("complete_size").alias("promised"),
    )
    enough = F.col("promised").isNull() | (F.col("records") >= F.col("promised"))
    ended = F.when(F.col("_kind") == "end", F.when(enough, "complete").otherwise("short")).otherwise(F.coalesce("_kind", F.lit("none")))
    return counts.join(last, "source", "left").select("source", "pages", "followed", "records", "promised", ended.alias("ended"))
