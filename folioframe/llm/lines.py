"""Line dedup with a fixed-depth template tree (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, dropped, saved, spread_join

#: Leading tokens that lead from a token count to a leaf; documents that make a template recurring.
DEPTH, LEAST_DOCS = 3, 4
#: Share of a template's places that must be fixed, in tenths; else the line stands for itself, word by word.
FIXED = 6
VARIABLE = "<*>"
#: A token with a digit is a variable field. Possessive, and from a token's first sign only: a long token is read once.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def words(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def tokens(line: Column) -> Column:
    """Tokens of a line, those with digits as variable fields."""
    return words(F.regexp_replace(line, FIELD, VARIABLE))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(_doc, _row, no, line): one row a line of docs (_doc, _row, _text)."""
    return docs.select("_doc", "_row", F.posexplode(F.split("_text", "\n")).alias("no", "line"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least_docs: int = LEAST_DOCS, keep_first: bool = True) -> DataFrame:
    """docs with _n_lines, _n_dropped, _kept: the lines left, joined by newlines.

    A line goes down the tree by its token count and its first `depth` tokens, variable fields (tokens
    with digits) alike; a shorter line by what tokens it has. In a leaf, a token is fixed where it stands
    at its place in lines of `least_docs` documents, each different line counted with its documents;
    other places are variable. That makes the line's template, if FIXED tenths of its places are fixed;
    else the line, with its variable fields, is its own template. A line with fewer tokens without digits
    than that has no template but its words as they are. Lines whose template stands in `least_docs`
    documents are dropped, but for the document with the smallest id that has it (keep_first=False:
    there too).

    Blank lines stay. Null texts have no lines and stay null; documents with a null id keep all lines and
    make nothing recur; rows with equal ids count as one document; an empty table gives no rows; lines
    and words of any length are read once; other columns pass through, names that begin with an
    underscore are ours.

    Only hashes of lines are shuffled; texts meet the leaves that need them and the dropped places once.
    Counts are taken before each join, which tells what is hot.
    """
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    own = docs.select(F.col(id_col).alias("_doc"), row.alias("_row"), F.col(text_col).cast("string").alias("_text")).where("_doc is not null and _text is not null")
    t, w, line = F.col("t"), F.col("w"), F.col("line")
    parted = numbered_lines(own).where(line.rlike(r"[^\x20\x09-\x0D]")).withColumn("_digits", line.rlike(r"[0-9]|<\*>"))
    # Most lines have no digit (and no mark of a field): these are split once and have no field.
    parted = parted.select("_doc", "_row", "no", words(line).alias("w"), F.when(F.col("_digits"), tokens(line)).alias("t"))
    told = t.isNull() | (F.size(F.filter(t, lambda x: x != VARIABLE)) * 10 >= F.size(t) * FIXED)
    parted = parted.withColumn("_told", told)
    parted = parted.select("_doc", "_row", "no", F.when(F.col("_told"), F.coalesce(t, w)).otherwise(w).alias("t"), "_told")
    parted = parted.select("_doc", "_row", "no", "t", F.when(F.col("_told"), F.slice(t, 1, depth)).otherwise(F.concat(F.array(F.lit("=")), t)).alias("lead"))
    leaf = F.xxhash64(F.size(t), "lead")
    places = saved(parted.select("_doc", "_row", "no", leaf.alias("leaf"), F.xxhash64(leaf, "t").alias("key")), "lines")
    total = places.count()
    by_doc = places.groupBy("leaf", "key", "_doc").agg(F.min(F.struct("_row", "no")).alias("m"), F.count("*").alias("n"))
    distinct = saved(by_doc.groupBy("leaf", "key").agg(F.count("*").alias("docs"), F.sum("n").alias("lines"), F.min(F.struct("_doc", "m")).alias("at")), "distinct")
    # A leaf's documents are at most the sum over its lines; where that is too low nothing can recur.
    crowded = distinct.groupBy("leaf").agg(F.sum("docs").alias("d"), F.count("*").alias("keys")).where(F.col("d") >= least_docs).where("keys > 1").drop("d")
    wanted = spread_join(distinct.select("leaf", "key", "docs", "at._doc", "at.m.*"), crowded, ["leaf"], "keys", distinct.count())
    texts = own.join(wanted.groupBy("_doc", "_row").agg(F.collect_list(F.struct("no", "leaf", "key", "docs")).alias("w")), ["_doc", "_row"])
    texts = texts.dropDuplicates(["_doc", "_row"]).withColumn("ls", F.split("_text", "\n")).select("ls", F.explode("w").alias("w"))
    worded = saved(texts.select("w.leaf", "w.key", "w.docs", tokens(F.get("ls", F.col("w.no"))).alias("t")), "worded")
    at = worded.select("leaf", "key", "docs", F.posexplode("t").alias("k", "token"))
    fixed = at.where(F.col("token") != VARIABLE).groupBy("leaf", "k", "token").agg(F.sum("docs").alias("n"), F.count("*").alias("rows")).where(F.col("n") >= least_docs).drop("n")
    standing = worded.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0]
    marks = spread_join(at.select("leaf", "key", "k", "token"), fixed, ["leaf", "k", "token"], "rows", standing).groupBy("leaf", "key").agg(F.collect_set("k").alias("ks"))
    shape = F.transform("t", lambda t, k: F.when(F.array_contains("ks", k), t).otherwise(F.lit(VARIABLE)))
    general = worded.join(marks, ["leaf", "key"]).where(F.size("ks") * 10 >= F.size("t") * FIXED).select("key", F.xxhash64("leaf", shape).alias("template"))
    general = saved(general.join(distinct.select("key", "lines"), "key"), "general")
    named = spread_join(places.select("_doc", "key"), general, ["key"], "lines", total)
    often = named.select("template", "_doc").distinct().groupBy("template").agg(F.count("*").alias("n"), F.min("_doc").alias("first")).where(F.col("n") >= least_docs).drop("n")
    often = often.join(general.groupBy("template").agg(F.count("*").alias("keys")), "template")
    by_shape = spread_join(general, often, ["template"], "keys", general.count()).select("key", "lines", "first")
    by_line = distinct.where(F.col("docs") >= least_docs).join(general.select("key"), "key", "left_anti").select("key", "lines", F.col("at._doc").alias("first"))
    recurring = saved(by_shape.unionByName(by_line), "recurring")
    gone = spread_join(places.select("_doc", "_row", "no", "key"), recurring, ["key"], "lines", total).where(F.lit(not keep_first) | (F.col("_doc") > F.col("first")))
    gone = saved(gone.groupBy("_doc", "_row").agg(F.collect_set("no").alias("_gone")), "gone")
    for table in (places, distinct, worded, general, recurring):
        dropped(table)
    out = docs.withColumns({"_doc": F.col(id_col), "_row": row}).join(gone, ["_doc", "_row"], "left").drop("_doc", "_row")
    out = out.withColumn("_lines", F.split(F.col(text_col), "\n"))
    out = out.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")))
    return out.withColumns(
        {
            "_n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_lines")).cast("long"),
            "_n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
            "_kept": F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform("_left", lambda k: F.get("_lines", k)), "\n")),
        }
    ).drop("_gone", "_lines", "_left")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, no, ls[no + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS no FROM d)),
w AS (SELECT doc_id, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS t FROM l),
told AS (SELECT *, len(list_filter(t, lambda x: x <> '<*>')) * 10 >= len(t) * 6 AS told FROM w WHERE len(w) > 0),
q AS (SELECT doc_id, no, len(t) AS n, CASE WHEN told THEN t ELSE w END AS t, CASE WHEN told THEN t[1:3] ELSE list_concat(['='], w) END AS lead FROM told),
u AS (SELECT n, lead, t, count(DISTINCT doc_id) AS docs FROM q GROUP BY n, lead, t),
c AS (SELECT n, lead, t, docs, unnest(t) AS token, unnest(range(n)) AS k FROM u),
f AS (SELECT n, lead, k, token FROM c WHERE token <> '<*>' GROUP BY n, lead, k, token HAVING sum(docs) >= 4),
m AS (SELECT c.n, lead, t, list(CASE WHEN f.k IS NULL THEN '<*>' ELSE c.token END ORDER BY c.k) AS shape, count(f.k) AS fixed FROM c LEFT JOIN f USING (n, lead, k, token) GROUP BY c.n, lead, t),
several AS (SELECT n, lead FROM u GROUP BY n, lead HAVING count(*) > 1),
named AS (
  SELECT doc_id, no, n, lead,
         CASE WHEN several.n IS NOT NULL AND fixed * 10 >= 6 * m.n THEN 'T' ELSE 'L' END AS kind,
         CASE WHEN several.n IS NOT NULL AND fixed * 10 >= 6 * m.n THEN shape ELSE t END AS template
  FROM q JOIN m USING (n, lead, t) LEFT JOIN several USING (n, lead)
),
often AS (SELECT n, lead, kind, template, min(doc_id) AS first FROM named GROUP BY n, lead, kind, template HAVING count(DISTINCT doc_id) >= 4),
gone AS (SELECT doc_id, no FROM named JOIN often USING (n, lead, kind, template) WHERE doc_id > first),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS kept, count(*) AS left_lines FROM l ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - coalesce(left_lines, 0), 0)::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
