"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

#: Weights by the rank of a source, and how many times a source may be used at most.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Key ranges for each factor e of the key; only the range in which a source's budget ends is sorted.
RANGES = 1 << 12
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[!-@\[-`{-~]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Share of a text's characters that are neither ASCII digits nor ASCII signs, in [0.05, 1]: a default quality weight that needs no labels and is the same for all scripts."""
    plain = F.length(F.regexp_replace(text, SIGNS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), plain / F.nullif(F.length(text), F.lit(0))), F.lit(0.05))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of the whole by weight, full sources cut off.

    Sources rank by code point, null last, and take the weights in turn. A source that would get more
    than `most` times its size stays there; the rest shares what is left. In order of size to weight
    the full sources come first, so the level follows from two running sums: the table has one row a
    source, and no document passes here.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("full", (F.col("source_size") * most).cast("double"))
    s = s.withColumn("ratio", F.col("full") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    up, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.sum("full").over(up) + F.col("full")) / (F.sum("w").over(whole) - F.sum("w").over(up) + F.col("w")))
    # The level at the first source that isn't full is everyone's: it is the largest one that its own source bears.
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(whole)["level"])
    return s.select("source", "source_size", F.least("full", F.col("w") * F.col("level")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    quality: Column | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_text: bool = True,
) -> DataFrame:
    """docs with _size, _source_size, _target and _taken: how many of each document's words the mix takes.

    A source whose target is q times its size and a rest takes every document q times, then documents
    by ascending -ln(u) / quality, u from a hash of seed and id, until the rest is used up; the last one
    is taken in part (its first words), so a source's taken words are its target rounded down. Null
    texts have size 0, null sources are one source, a null id hashes as an empty one; a quality that is null
    or no number counts as 0.05, any other is kept within 1e-6 to 1e6; rows with the
    same key are ordered by id and a hash of the text, and equal rows share their place, so reruns agree. An empty
    table gives no rows. Other columns pass through; names that begin with an underscore are ours.

    Sums over (source, key range) find the range where each budget ends; only its documents are sorted,
    so that a source of any size takes no long sort.
    """
    text, source = F.col(text_col), F.col(source_col).cast("string")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    q = text_quality(text) if quality is None else F.least(F.greatest(F.nanvl(F.coalesce(quality.cast("double"), F.lit(0.05)), F.lit(0.05)), F.lit(1e-6)), F.lit(1e6))
    keyed = docs.withColumns({"_size": word_count(text), "_key": -F.log(u) / q, "_src": source})
    # On a logarithmic scale the keys of any one quality are equally dense, only shifted: about one in 11,000 in a range.
    keyed = keyed.withColumn("_range", F.coalesce(F.floor(F.log("_key") * RANGES).cast("int"), F.lit(-(1 << 31))))
    keyed = keyed.withColumn("_tie", F.xxhash64(text))
    if not keep_text:  # then the later readings see a small written table; texts are measured anew instead of written
        keyed = saved(keyed.drop(text_col), "mix")
    sums = keyed.groupBy(F.col("_src").alias("source"), "_range").agg(F.sum("_size").alias("n"))
    shares = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    shares = shares.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    shares = shares.withColumn("_rest", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    by_range = Window.partitionBy("source").orderBy("_range")
    ends = sums.withColumn("upto", F.sum("n").over(by_range)).join(shares.select(F.col("source").alias("s"), "_rest"), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where((F.col("upto") > F.col("_rest")) & (F.col("upto") - F.col("n") <= F.col("_rest")))
    ends = ends.groupBy("source").agg(F.min("_range").alias("_last"), F.min(F.struct("_range", (F.col("_rest") - F.col("upto") + F.col("n")).alias("left")))["left"].alias("_left"))
    plan = shares.join(ends.select(F.col("source").alias("s"), "_last", "_left"), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = plan.select(F.col("source").alias("_plan_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_epochs", "_last", "_left")
    # One row a source, written, so that its size is known: small ones are broadcast, a large one is joined by shuffle.
    plan = saved(plan, "plan")
    planned = keyed.join(plan, F.col("_src").eqNullSafe(F.col("_plan_src")))
    inside = F.col("_last").isNotNull() & (F.col("_range") == F.col("_last"))
    order = Window.partitionBy("_plan_src").orderBy("_key", id_col, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = planned.where(inside).withColumn("_part", F.greatest(F.lit(0), F.least("_size", F.col("_left") - F.sum("_size").over(order) + F.col("_size"))))
    rest = planned.where(~inside).withColumn("_part", F.when(F.col("_last").isNotNull() & (F.col("_range") < F.col("_last")), F.col("_size")).otherwise(0).cast("long"))
    return cut.unionByName(rest).withColumn("_taken", F.col("_epochs") * F.col("_size") + F.col("_part"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, as often as it takes them: the columns of docs.

    The document in which a source's budget ends appears once more with the words taken of it, joined
    by one space.
    """
    text = options.get("text_col", "text")
    out = mix(docs, **options)
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    whole = F.array_repeat(F.col(text), (F.col("_epochs") + (F.col("_part") == F.col("_size")).cast("long") * (F.col("_part") > 0).cast("long")).cast("int"))
    part = F.when((F.col("_part") > 0) & (F.col("_part") < F.col("_size")), F.array(F.array_join(F.slice(words, 1, F.col("_part").cast("int")), " "))).otherwise(F.array().cast("array<string>"))
    out = out.where("_taken > 0").withColumn("_copy", F.explode(F.concat(whole, part)))
    return out.select(*[F.col("_copy").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, keep_text=False).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")
    )


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(concat('0x', substr(md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / coalesce(greatest(0.05::DOUBLE, length(regexp_replace(text, '[!-@\[-`{-~]+', '', 'g')) / length(text)), 0.05::DOUBLE) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT)] AS w
  FROM d GROUP BY source
), fill AS (  -- shares by weight; whoever gets too much stays at the limit and the rest is shared anew
  SELECT 0 AS step, source, source_size, w, false AS held, (SELECT sum(source_size) FROM s) * w / (SELECT sum(w) FROM s) AS share FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w, held OR share > 3 * source_size,
         CASE WHEN held OR share > 3 * source_size THEN 3.0 * source_size
              ELSE (sum(source_size) OVER () - sum(CASE WHEN held OR share > 3 * source_size THEN 3.0 * source_size ELSE 0 END) OVER ()) * w
                   / sum(CASE WHEN held OR share > 3 * source_size THEN 0 ELSE w END) OVER () END
  FROM fill WHERE step < 40
), t AS (
  SELECT source, source_size, CAST(share AS DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(share / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM fill WHERE step = 40
)
SELECT doc_id, size, source_size, target,
       epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, text ROWS UNBOUNDED PRECEDING) - size)))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
