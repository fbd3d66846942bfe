"""Reports over records: imports, assessments, changes, links in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quality as Q
from ..operators import ranking as W
from ..operators import reports as X
from ..operators import retrieval as R
from .records import AS_OF, QUALITY, full_records
from .registry import query
from .views import PUBLICATIONS, heading, publications, table

_HEAD = r"trim(regexp_replace(coalesce(regexp_extract(text, '^[^.!?\n]*'), ''), '[\s\x1c-\x1f]+', ' ', 'g'))"
_KEY = rf"nullif(trim(regexp_replace(regexp_replace(lower({_HEAD}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '[\s\x1c-\x1f]+', ' ', 'g')), '')"
#: What an import says of a record: (condition for SQL, message).
_ERROR = f"CASE WHEN {_HEAD} = '' THEN 'A record is missing its title' WHEN length({_HEAD}) > 1000 THEN 'A title is too long' WHEN len(string_split({_HEAD}, ' ')) < 2 THEN 'A title has one word' END"


def _import(spark, sf):
    """documents as an import: a source is a run, toxic ones are deleted; those with a quality label are stored already."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality")), "doc_id", "left")
    title = F.coalesce(S.clean(heading(F.col("text"))), F.lit(""))
    d = d.select(F.col("source").alias("run"), F.col("doc_id").alias("record_index"), F.col("doc_id").alias("record_id"), title.alias("title"), S.identity_title(title).alias("key_title"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_deleted"), "quality")
    error = F.when(F.col("title") == "", "A record is missing its title").when(F.length("title") > 1000, "A title is too long").when(F.size(F.split("title", " ")) < 2, "A title has one word")
    return d.withColumn("error", error)


_IMPORT = f"""WITH l AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT source AS run, doc_id, {_KEY} AS key_title, coalesce(toxic, 0) = 1 AS gone, quality, {_ERROR} AS error FROM documents LEFT JOIN l USING (doc_id)),
k AS (SELECT DISTINCT key_title FROM d WHERE quality = 1 AND key_title IS NOT NULL),
r AS (SELECT d.*, k.key_title IS NOT NULL AS known, row_number() OVER (PARTITION BY run, error IS NULL ORDER BY doc_id) AS r FROM d LEFT JOIN k USING (key_title))
SELECT run, count(*) AS seen, count(*) FILTER (error IS NULL) AS valid, count(*) FILTER (error IS NOT NULL) AS invalid, count(*) FILTER (error IS NULL AND NOT gone) AS active, count(*) FILTER (error IS NULL AND gone) AS deleted, count(*) FILTER (error IS NULL AND NOT gone AND NOT known) AS likely_creates,
coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY r) FILTER (error IS NULL AND r <= 20), '') AS sample, coalesce(string_agg(doc_id || ':' || error, ',' ORDER BY r) FILTER (error IS NOT NULL AND r <= 100), '') AS errors FROM r GROUP BY run"""


@query("a15_import_report", _IMPORT)
def import_report(spark, sf):
    """What an import would do, by run: counts, the first 20 valid records and the first 100 errors."""
    r = _import(spark, sf)
    out = X.import_report(r, r.where("quality = 1"))
    told = F.array_join(F.transform("errors", lambda e: F.concat(e["record_index"].cast("string"), F.lit(":"), e["message"])), ",")
    return out.select("run", "seen", "valid", "invalid", "active", "deleted", "likely_creates", F.array_join(F.transform("sample", lambda i: i.cast("string")), ",").alias("sample"), told.alias("errors"))


_MEANS = ", ".join(f"round(avg({d}_score) + 1e-9, 2) AS {d}" for d in Q.WEIGHTS)


@query("a8_score_means", QUALITY + f"SELECT publication_id % 17 = 0 AS is_deleted, grade, count(*) AS n, {_MEANS}, round(avg(final_score) + 1e-9, 2) AS final FROM q GROUP BY ALL")
def score_means(spark, sf):
    """Means of the seven scores, halves up, by grade and whether the record is deleted."""
    a = Q.assessed(full_records(spark, sf), AS_OF).withColumn("is_deleted", F.col("publication_id") % 17 == 0)
    # what a sum of doubles loses must not turn a half down
    mean = lambda c: F.round(F.avg(c) + 1e-9, 2)
    return a.groupBy("is_deleted", "grade").agg(F.count("*").alias("n"), *[mean(f"{d}_score").alias(d) for d in Q.WEIGHTS], mean("final_score").alias("final"))


_LATER = QUALITY.replace("<= 562", "<= 622").replace("> 562", "> 622").replace("562 - harvested", "622 - harvested")


def _reports(sql):
    lists = "array_to_string(missing, ',') AS missing, list_sort(errors) AS errors, list_sort(warnings) AS warnings"
    return sql + f"SELECT publication_id, final_score, grade, {lists} FROM q"


@query("q9_changed_reports", f"SELECT n.publication_id, concat_ws(',', CASE WHEN n.final_score <> o.final_score THEN 'final_score' END, CASE WHEN n.grade <> o.grade THEN 'grade' END, CASE WHEN n.missing <> o.missing THEN 'missing_fields' END, CASE WHEN n.errors <> o.errors THEN 'validation_errors' END, CASE WHEN n.warnings <> o.warnings THEN 'warnings' END, CASE WHEN n.publication_id % 50 = 0 THEN 'ruleset_version' END) AS changed FROM ({_reports(_LATER)}) n JOIN ({_reports(QUALITY)}) o USING (publication_id) WHERE n.final_score <> o.final_score OR n.grade <> o.grade OR n.missing <> o.missing OR n.errors <> o.errors OR n.warnings <> o.warnings OR n.publication_id % 50 = 0")
def changed_reports(spark, sf):
    """What sixty days change in the reports: score, grade, any list, and the rules' version, which every fiftieth report had an older one of."""
    r = full_records(spark, sf)
    version = lambda old: F.when(F.lit(old) & (F.col("publication_id") % 50 == 0), "1").otherwise("2")
    old, new = (Q.assessed(r, at).withColumns({"ruleset_version": version(first), "recommendations": F.transform("missing_fields", lambda f: F.concat(F.lit("provide "), f))}) for first, at in ((True, AS_OF), (False, "2024-09-14 00:00:00")))
    fields = tuple(f for f in X.REPORTED if f != "recommendations")  # they follow from the missing fields
    out = X.changed_reports(old.withColumns({c: F.array_sort(c) for c in ("validation_errors", "warnings")}), new.withColumns({c: F.array_sort(c) for c in ("validation_errors", "warnings")}), "publication_id", fields)
    return out.select("publication_id", F.array_join("changed", ",").alias("changed"))


@query("f46_version_classes", PUBLICATIONS + "SELECT publication_id, min(publication_id) OVER (PARTITION BY abstract, publication_year, doi, author_id % 3, publication_id % 2) AS first_id FROM publications")
def version_classes(spark, sf):
    """Publications of one metadata hash over title, year, DOI, address and authors, nulls among them."""
    p = publications(spark, sf)
    url = F.concat(F.lit("https://r.org/"), (F.col("publication_id") % 2).cast("string"))
    names = F.array(F.concat(F.lit("Author, "), (F.col("author_id") % 3).cast("string")), F.lit("B"))
    h = p.select("publication_id", S.metadata_hash(F.col("abstract"), F.col("publication_year"), F.col("doi"), url, names).alias("h"))
    return h.join(h.groupBy("h").agg(F.min("publication_id").alias("first_id")), "h").select("publication_id", "first_id")


@query("d15_all_invalidations", PUBLICATIONS + "SELECT publication_id, CASE WHEN publication_id % 7 = 0 OR publication_id % 11 = 0 OR (publication_id % 13 <> 0 AND publication_id % 19 = 0) OR publication_id % 23 = 0 OR publication_id % 29 = 0 THEN NULL ELSE sha256(title || coalesce(abstract, '')) END AS content_hash FROM publications")
def all_invalidations(spark, sf):
    """A vector is stale if title, abstract, type, authors or keywords have changed; a new date or address leaves it."""
    k = F.col("publication_id")
    p = publications(spark, sf).withColumn("keywords", F.array("language", "source")).withColumn("names", F.array(F.col("author_id").cast("string")))
    new = p.withColumns({
        "title": F.when(k % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), "abstract": F.when(k % 19 == 0, F.concat("abstract", F.lit(" more"))).otherwise(F.col("abstract")), "source_type": F.when(k % 11 == 0, "other").otherwise(F.col("source_type")),
        "names": F.when(k % 23 == 0, F.array(F.lit("x"))).otherwise(F.col("names")), "keywords": F.when(k % 29 == 0, F.array("language")).otherwise(F.col("keywords")), "updated_at": F.current_timestamp(),
    })
    as_text = lambda df: df.withColumns({c: F.to_json(c) for c in ("names", "keywords")})
    touched = W.changes(as_text(p), as_text(new), "publication_id", ["title", "abstract", "source_type", "names", "keywords"]).select("publication_id", F.lit(True).alias("t")).distinct()
    return p.join(touched, "publication_id", "left").select("publication_id", F.when(F.col("t").isNull(), F.sha2(F.concat("title", F.coalesce("abstract", F.lit(""))), 256)).alias("content_hash"))


@query("r17_document_links", f"""WITH p AS (SELECT page_id, len(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["''][^"''>\\s]+["'']')) AS before, regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) AS root FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/?#]+')),
own AS (SELECT page_id, before, root, i, CASE i WHEN 0 THEN root || '/files/' || page_id || '.PDF?x=1' WHEN 2 THEN root || '/bitstreams/' || page_id || '/content' END AS link FROM p, (SELECT unnest([0, 2]) AS i) WHERE i = 0 OR page_id % 3 = 0)
SELECT page_id, (before + i)::INT AS position, link FROM own""".replace("\\\\", "\\"))
def document_links(spark, sf):
    """Links to documents on a page's host: to each page are added one of a file, one elsewhere, one of a bitstream in every third, and a repeat."""
    k = F.col("page_id").cast("string")
    third = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a href="/bitstreams/'), k, F.lit('/content">b</a>'))).otherwise("")
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="/files/'), k, F.lit('.PDF?x=1">f</a><a href="https://elsewhere.example.net/x.pdf">e</a>'), third, F.lit('<iframe src=\'/files/'), k, F.lit(".PDF?x=1'></iframe><a href='/about?to=a.pdf'>n</a>"))
    return R.document_links(table(spark, sf, "pages").select("page_id", "url", html.alias("html")))
