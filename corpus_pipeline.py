"""From raw documents to a packed training corpus, as stages that are each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; the last returns one row a document of the packed corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import dropped, parted, saved, scratch
from folioframe.llm.decontamination import contamination
from folioframe.llm.jaccard import near_copies
from folioframe.llm.language import accepted_documents
from folioframe.llm.mixing import mixed
from folioframe.llm.packing import packed_digest


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go."""
    return accepted_documents(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in 0.8 of their five-word runs one row stays: of the smallest id (null ids last) the text of least hash."""
    named = near_copies(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_tid")
    least = named.groupBy("_group").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1")
    of = named.join(least, "_group").select("doc_id", "_tid", (place == F.col("least")).alias("stays"))
    # What goes is written first: its size is then known, and a small list costs no shuffle of texts.
    gone = saved(of.where("not stays").select(F.col("doc_id").alias("_id"), F.col("_tid").alias("_gone")).distinct(), "gone")
    twice = of.where("stays").groupBy("doc_id", "_tid").count().where("count > 1")
    twice = saved(twice.select(F.col("doc_id").alias("_id"), F.col("_tid").alias("_twice")), "twice")
    # Only rows that either list may name are shuffled with their texts.
    lists = gone.unionByName(twice.withColumnRenamed("_twice", "_gone")).select(F.col("_id").alias("doc_id"), F.col("_gone").alias("_tid"))
    listed, rest = parted(docs.withColumn("_tid", F.xxhash64("text")), lists, ["doc_id", "_tid"])
    left = listed.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tid") == F.col("_gone")), "left_anti")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tid") == F.col("_twice"))
    one = left.join(twice, same, "left_semi").groupBy("doc_id", "_tid").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("_d"))
    kept = left.join(twice, same, "left_anti").select(docs.columns)
    return rest.select(docs.columns).unionByName(kept).unionByName(one.select("doc_id", "_d.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words inside occurrences of benchmark windows go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where(F.size("begins") > 0).select("_id", F.col("_tid").alias("_hit")).distinct()
    hit = saved(hit, "hit")  # written, so that its size is known: a small one is broadcast and no text is shuffled
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tid") == F.col("_hit"))
    return docs.withColumn("_tid", F.xxhash64("text")).join(hit, same, "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; n_chars of a shortened one is counted anew."""
    return mixed(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed corpus, read back: doc_id, start, n_tokens, ids_crc32 of every document in it."""
    return packed_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("decontamination", decontaminated), ("mixing", mixture), ("token_output", packed)]

#: Hash families, a learned language model and a tokenizer file are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself, and what it read, goes when its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = saved(stage(spark, docs, sf_dir), f"stage-{name}", kept=True)
        if before is not None:
            dropped(before)
        before = docs
    with scratch():
        out = saved(STAGES[-1][1](spark, docs, sf_dir), "stage-token_output", kept=True)
    dropped(docs)
    return out
