"""How filters overlap, and what each of them costs in every order of application (operator 11)."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
GAPS = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs: DataFrame, text: str) -> DataFrame:
    """docs with `bits`, the conditions A to D that the text (never null) fails; A is bit 0.

    The words are a column of their own, so that a text is split once for both of its measures.
    """
    split = docs.withColumn("_words", F.array_remove(F.split(text, GAPS), ""))
    n, distinct = F.size("_words").cast("long"), F.size(F.array_distinct("_words")).cast("long")
    # Counted by splitting: a replacement is inlined into the stage's code, which then is too long to be compiled.
    capitals, length = (F.size(F.split(text, "[A-Z]")) - 1).cast("long"), F.length(text).cast("long")
    measured = split.withColumns({"_n": n, "_distinct": distinct, "_capitals": capitals, "_length": length, "_signs": F.col(text).rlike(SIGNS)})
    failed = (F.col("_n") < LEAST_WORDS, F.col("_distinct") * 100 < F.col("_n") * LEAST_DISTINCT, F.col("_capitals") * 100 > F.col("_length") * MOST_CAPITALS, F.col("_signs"))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return measured.withColumn("bits", bits).drop("_words", "_n", "_distinct", "_capitals", "_length", "_signs")


def cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row a part and failure mask: (part, mask, n, good, toxic), documents that fail exactly the filters of the mask.

    The texts stay where they are read: from there on go an id, a digest of 32 bytes and four bits. A text is a
    repeat (bit 4) if its digest has a smaller id; the least id of a digest meets counts by part and mask, never
    single copies, so that a group of any number of copies is a few rows when it comes together.

    A null part is the empty string. A null id has no label, repeats nothing and is repeated by nothing; rows of
    one id are each counted, and a smaller id is one that differs. A document is good or toxic if any of
    its label rows says so.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), whole.alias("_text"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"))
    own = failures(own, "_text").select("_id", "part", "bits", "digest")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_marked")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    # Rows without an id would all meet in one task of the join: they get ids of their own kind there, which nothing matches.
    key = F.when(F.col("_id").isNull(), F.concat(F.lit("-"), F.hex("digest"))).otherwise(F.col("_id").cast("string"))
    own = own.withColumn("_key", key).join(marks.withColumn("_key", F.col("_marked").cast("string")), "_key", "left")
    own = own.select("_id", "part", "bits", "digest", F.coalesce("_good", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"))
    group = ["digest", "part", "bits", "good", "toxic"]
    # How often the least id of each group stands in it is known without a second look at the rows.
    one = own.groupBy(*group, "_id").agg(F.count("*").alias("n"))
    some = one.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n"))).alias("least"))
    met = some.withColumn("first", F.min("least._id").over(Window.partitionBy("digest")))
    fresh = F.col("nameless") + F.when(F.col("least._id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("bits").alias("mask"), fresh.alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - fresh).alias("n")))
    split = met.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def folded(cell: Column, orders: Column) -> Column:
    """What one cell adds to each step of each order: its documents fall at the first filter that they fail.

    Folds the cell along every order, carrying whether it is still there; the steps come out weighted with its counts.
    """
    none = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        falls = state["there"] & fails
        own = F.struct(
            F.when(state["there"] & ~fails, cell["n"]).otherwise(none).alias("kept"),
            F.when(falls, cell["n"]).otherwise(none).alias("removed"),
            F.when(fails & ~state["there"], cell["n"]).otherwise(none).alias("redundant"),
            F.when(cell["mask"] == bit, cell["n"]).otherwise(none).alias("unique_fails"),
            F.when(falls, cell["good"]).otherwise(none).alias("good_lost"),
            F.when(falls, cell["toxic"]).otherwise(none).alias("toxic_lost"),
        )
        return F.struct((state["there"] & ~fails).alias("there"), F.concat(state["steps"], F.array(own)).alias("steps"))

    nothing = F.from_json(F.lit("[]"), "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
    start = F.struct(F.lit(True).alias("there"), nothing.alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["steps"])))


def audit(cell_counts: DataFrame, filters: str = LETTERS) -> DataFrame:
    """(part, mask, n, good, toxic) to one row a part, order and step: filter_order, step, COUNTS and shapley.

    A part has at most 2 ** len(filters) cells, which are folded where they meet and added up element by
    element; the orders are a constant that every task has. No cells give no rows.
    """
    named = list(permutations(range(len(filters))))
    orders = F.array(*[F.array(*(F.lit(1 << i) for i in o)) for o in named])
    names = F.array(*[F.lit("".join(filters[i] for i in o)) for o in named])
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    zeros = F.array_repeat(zero, len(named) * len(filters))

    def plus(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])

    # Few bytes, much work: a number of tasks is asked for, or adaptive execution would make one of them.
    met = cell_counts.repartition(int(cell_counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    summed = met.select("part", F.aggregate("cells", zeros, lambda acc, cell: F.zip_with(acc, folded(cell, orders), plus)).alias("steps"))
    def over_all_orders(bit: int) -> Column:
        own = F.zip_with("steps", F.flatten(orders), lambda s, b: F.when(b == bit, s["removed"]).otherwise(F.lit(0).cast("long")))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, n: acc + n)

    worth = F.array(*[over_all_orders(1 << i) for i in range(len(filters))])
    rows = summed.select("part", worth.alias("worth"), F.posexplode("steps").alias("at", "s"))
    name, step = F.element_at(names, (F.floor(F.col("at") / len(filters)) + 1).cast("int")), (F.col("at") % len(filters) + 1).cast("int")
    shapley = F.element_at("worth", F.instr(F.lit(filters), F.substring(name, step, F.lit(1))))
    return rows.select("part", name.alias("filter_order"), step.alias("step"), "s.*", shapley.alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(cells(docs, labels))


OP11_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS failed
  FROM d LEFT JOIN l USING (doc_id)
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)
), steps AS (
  SELECT o AS filter_order, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step) WHERE length(o) = 5
), j AS (
  SELECT part, filter_order, step, x, good, toxic, failed = x AS alone, contains(failed, x) AS fails, before <> '' AND regexp_matches(failed, '[' || before || '_]') AS gone
  FROM f, steps
), c AS (
  SELECT part, filter_order, step, x, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
         count(*) FILTER (alone) AS unique_fails, count(*) FILTER (fails AND NOT gone AND good) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic) AS toxic_lost
  FROM j GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c
"""
