"""The concepts of a bibliographic catalogue over the given tables, in both languages.

orders are publications, customers their authors, lineitem the keyword links, part the keywords,
supplier the connectors, nation the repositories, region the institutions; documents hold full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A document's title: its first sentence or line, whatever its length, without the sign that ends it.
HEADING = r"regexp_extract(text, '^[^.!?\n]*')"


def heading(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^.!?\n]*", 0)


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("publication_id"),
        F.concat(F.lit("Study "), key.cast("string"), F.lit(" of "), F.col("o_orderpriority")).alias("title"),
        F.when(key % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("An abstract on "), F.col("o_orderpriority"))).alias("abstract"),
        F.when(key % 29 == 0, F.lit(None)).otherwise(F.year("o_orderdate")).alias("publication_year"),
        F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("source"),
        F.when(key % 3 == 0, "journal").when(key % 3 == 1, "repository").otherwise("etd").alias("source_type"),
        F.when(key % 2 == 0, "en").otherwise("am").alias("language"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("10.1234/p."), (key - key % 3).cast("string"))).alias("doi"),
        (key % 17 == 0).alias("is_deleted"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.round(F.col("o_totalprice") % 100, 2)).alias("quality_score"),
        F.col("o_custkey").alias("author_id"),
        (F.col("o_custkey") % 25).cast("int").alias("repository_id"),
    )


#: The same view for the comparison engine; the queries begin with it.
PUBLICATIONS = """WITH publications AS (
  SELECT o_orderkey AS publication_id,
         'Study ' || o_orderkey || ' of ' || o_orderpriority AS title,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'An abstract on ' || o_orderpriority END AS abstract,
         CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS publication_year,
         'src' || (o_custkey % 20) AS source,
         CASE o_orderkey % 3 WHEN 0 THEN 'journal' WHEN 1 THEN 'repository' ELSE 'etd' END AS source_type,
         CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'am' END AS language,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '10.1234/p.' || (o_orderkey - o_orderkey % 3) END AS doi,
         o_orderkey % 17 = 0 AS is_deleted,
         o_orderdate AS updated_at,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round(o_totalprice % 100, 2) END AS quality_score,
         o_custkey AS author_id,
         (o_custkey % 25)::INT AS repository_id
  FROM orders
)
"""


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("author_id"), F.col("c_name").alias("full_name"), F.lower("c_name").alias("normalized_name"), F.col("c_nationkey").alias("university_id"), F.col("c_mktsegment").alias("department")
    )


def keyword_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("publication_id"), F.col("l_partkey").alias("keyword_id"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("keyword_id"), F.col("p_name").alias("term"), F.lower("p_name").alias("normalized_term"), F.col("p_type").alias("vocabulary"))


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 4 != 0).alias("enabled"),
        F.when(F.col("s_acctbal") > 0, "active").otherwise("paused").alias("status"), F.lit("oai_pmh").alias("connector_type"),
    )


CONNECTORS = """connectors AS (
  SELECT 'src' || s_suppkey AS code, s_name AS name, s_suppkey % 4 <> 0 AS enabled, CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'paused' END AS status, 'oai_pmh' AS connector_type
  FROM supplier
)
"""
