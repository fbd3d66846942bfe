"""Identity, resolution and quality over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import identity as D
from ..operators import quality as Q
from .registry import query
from .views import HEADING, PUBLICATIONS, heading, publications, table

AS_OF = "2024-07-16 00:00:00"


def full_records(spark, sf):
    """documents as bibliographic records, with faults at fixed steps of the id."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    url = F.concat(F.lit("https://repo.example.org/item/"), k.cast("string"))
    none = F.lit(None).cast("string")
    return d.select(
        k.alias("publication_id"), F.when(k % 31 == 0, "N/A").when(k % 43 == 0, "Soils").when(k % 61 == 0, F.repeat(F.lit("Soil water "), 60)).otherwise(S.title(heading(F.col("text")))).alias("title"),
        F.when(k % 7 == 0, none).when(k % 47 == 0, "None").otherwise(S.clean(F.col("text"))).alias("abstract"),
        F.when(k % 19 == 0, F.array().cast("array<string>")).when(k % 23 == 0, F.array(F.lit("Abebe Kebede"), F.lit("abebe kebede "))).when(k % 53 == 0, F.array(F.lit("Aster"), F.lit("  "))).otherwise(F.array(F.concat(F.lit("Author "), (k % 97).cast("string")))).alias("authors"),
        F.when(k % 13 == 0, F.array(F.lit("  Health  "), F.lit("Health"))).otherwise(F.array(F.lit("soil"), F.col("lang"))).alias("keywords"), F.when(k % 59 == 0, F.array(F.lit(" x"))).otherwise(F.array(F.col("lang"))).alias("subjects"),
        F.when(k % 29 == 0, 3020).when(k % 67 == 0, F.lit(None).cast("int")).otherwise((2000 + k % 25).cast("int")).alias("publication_year"), F.when(k % 3 == 0, F.make_date((2000 + k % 25).cast("int"), F.lit(5), F.lit(1))).alias("publication_date"),
        F.when(k % 5 == 0, none).when(k % 11 == 0, "bad-doi").otherwise(F.concat(F.lit("10.1234/d."), k.cast("string"))).alias("doi"), F.when(k % 71 == 0, F.array(F.lit("0000-1"))).otherwise(F.array(F.lit("0000-0002-1825-0097"))).alias("orcids"),
        F.when(k % 73 == 0, "english!").otherwise(F.col("lang")).alias("language"), "source", F.lit("repository").alias("source_type"), F.when(k % 17 == 0, none).otherwise(F.concat(F.lit("oai:"), k.cast("string"))).alias("external_id"),
        F.concat(F.lit("r"), k.cast("string")).alias("repository_identifier"), F.lit("{}").alias("raw_record"), F.when(k % 79 == 0, "Soil Journal").otherwise("Press").alias("publisher"), F.when(k % 79 == 0, "Jimma University").otherwise("Annals").alias("journal"),
        F.when(k % 41 == 0, F.concat(F.lit("ftp://x/"), k.cast("string"))).when(k % 83 == 0, none).otherwise(url).alias("article_url"), F.when(k % 37 == 0, F.upper(url)).when(k % 4 == 0, F.concat(url, F.lit(".pdf"))).alias("pdf_url"), F.array().cast("array<string>").alias("source_urls"),
        F.when(k % 2 == 0, "CC BY 4.0").when(k % 3 == 0, "all rights kept").alias("license_name"), F.when(k % 89 == 0, "creativecommons.org/x").alias("license_url"), none.alias("license"),
        F.when(k % 101 != 0, F.timestamp_seconds(F.lit(1672531200) + k % 700 * 86400)).alias("harvested_at"), F.timestamp_seconds(F.lit(1672531200) + k % 680 * 86400).alias("repository_datestamp"), (k % 17 == 0).alias("is_deleted"),
    )


_TIDY = r"nullif(trim(regexp_replace({}, '[\s\x1c-\x1f]+', ' ', 'g')), '')"
#: The same records and their assessment for the comparison engine: one row a record.
QUALITY = (
    r"""WITH r AS (SELECT doc_id AS k,
CASE WHEN doc_id % 31 = 0 THEN 'N/A' WHEN doc_id % 43 = 0 THEN 'Soils' WHEN doc_id % 61 = 0 THEN trim(repeat('Soil water ', 60)) ELSE coalesce(nullif(regexp_replace(TITLE, '[ /:]+$', ''), ''), '') END AS title,
CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 47 = 0 THEN 'None' ELSE coalesce(ABSTRACT, '') END AS abstract,
CASE WHEN doc_id % 29 = 0 THEN 3020 WHEN doc_id % 67 = 0 THEN NULL ELSE 2000 + doc_id % 25 END AS year, CASE WHEN doc_id % 3 = 0 THEN 2000 + doc_id % 25 END AS dated,
doc_id % 19 <> 0 AS authored, NOT (doc_id % 19 <> 0 AND doc_id % 23 = 0) AS authors_apart, NOT (doc_id % 19 <> 0 AND doc_id % 23 <> 0 AND doc_id % 53 = 0) AS authors_named,
doc_id % 37 <> 0 OR doc_id % 41 = 0 OR doc_id % 83 = 0 AS apart, doc_id % 41 <> 0 AS urls_fine, NOT (doc_id % 83 = 0 AND doc_id % 41 <> 0) AS linked,
CASE WHEN doc_id % 101 <> 0 THEN doc_id % 700 END AS harvested, doc_id % 680 AS stamped, doc_id % 89 = 0 AS odd_licence, doc_id % 2 = 0 OR doc_id % 89 = 0 AS licensed, doc_id % 3 = 0 AS some_licence, lang
FROM documents),
c AS (SELECT *, [CASE WHEN title = '' THEN 'title' END, CASE WHEN NOT authored THEN 'authors' END, CASE WHEN abstract = '' THEN 'abstract' END, CASE WHEN year IS NULL AND dated IS NULL THEN 'publication_date' END, CASE WHEN k % 17 = 0 THEN 'external_id' END] AS lacks,
[CASE WHEN lower(title) IN ('n/a', '-', '--', 'na', 'none', 'null', 'tbd', 'test', 'untitled', 'no title', 'not available', 'no abstract', 'no abstract available', 'abstract') THEN 'placeholder_title' WHEN title <> '' AND length(title) < 8 THEN 'short_title' END,
 CASE WHEN coalesce(year, dated) > 2025 THEN 'invalid_publication_year' END, CASE WHEN k % 5 <> 0 AND k % 11 = 0 THEN 'invalid_doi' END, CASE WHEN k % 71 = 0 THEN 'invalid_orcid' END, CASE WHEN NOT urls_fine THEN 'invalid_url' END, CASE WHEN k % 73 = 0 THEN 'invalid_language' END, CASE WHEN NOT authors_named THEN 'empty_author_name' END, CASE WHEN odd_licence THEN 'invalid_license_url' END,
 CASE WHEN harvested > 562 THEN 'future_harvested_at' END, CASE WHEN stamped > 562 THEN 'future_repository_datestamp' END, CASE WHEN year > 2025 THEN 'future_publication_year' END] AS errs,
[CASE WHEN length(title) > 500 THEN 'long_title' END, CASE WHEN abstract <> '' AND (length(abstract) < 20 OR lower(abstract) IN ('n/a', '--', 'na', 'none', 'null')) THEN 'weak_abstract' END, CASE WHEN dated <> year THEN 'date_year_mismatch' END, CASE WHEN k % 79 = 0 THEN 'publisher_journal_swapped' END,
 CASE WHEN k % 13 = 0 THEN 'unnormalized_keywords' END, CASE WHEN k % 59 = 0 THEN 'unnormalized_subjects' END, CASE WHEN NOT apart THEN 'pdf_matches_article_url' END, CASE WHEN NOT authors_apart THEN 'duplicate_authors' END, CASE WHEN k % 13 = 0 OR lang = 'soil' THEN 'duplicate_keywords' END, CASE WHEN NOT apart THEN 'duplicate_urls' END,
 CASE WHEN stamped > harvested THEN 'repository_datestamp_after_harvest' END, CASE WHEN 562 - harvested > 365 THEN 'stale_harvest' END, CASE WHEN NOT licensed THEN CASE WHEN some_licence THEN 'unrecognized_license' ELSE 'missing_license' END END, CASE WHEN k % 17 = 0 THEN 'record_deleted' END] AS warns FROM r),
g AS (SELECT *, list_filter(list_concat(lacks, [CASE WHEN harvested IS NULL THEN 'harvested_at' END, CASE WHEN NOT linked THEN 'article_url' END]), lambda x: x IS NOT NULL) AS missing, list_filter(errs, lambda x: x IS NOT NULL) AS errors, list_filter(warns, lambda x: x IS NOT NULL) AS warnings FROM c),
s AS (SELECT k AS publication_id, missing, errors, warnings,
round((8 - len(list_filter(lacks, lambda x: x IS NOT NULL))) * 100.0 / 8, 2)::DOUBLE AS completeness_score,
round(((title <> '' AND errs[1] IS NULL)::INT + (abstract <> '' AND warns[2] IS NULL)::INT + coalesce(coalesce(year, dated) BETWEEN 1800 AND 2025, false)::INT + (errs[3] IS NULL)::INT + (errs[4] IS NULL)::INT + urls_fine::INT + (errs[6] IS NULL)::INT + authors_named::INT + (NOT odd_licence)::INT) * 100.0 / 9, 2)::DOUBLE AS validity_score,
round((coalesce(dated = year, true)::INT + (k % 79 <> 0)::INT + (k % 13 <> 0)::INT + (k % 59 <> 0)::INT + apart::INT) * 100.0 / 5, 2)::DOUBLE AS consistency_score,
round((authors_apart::INT + (k % 13 <> 0 AND lang <> 'soil')::INT + apart::INT) * 100.0 / 3, 2)::DOUBLE AS uniqueness_score,
round((coalesce(harvested <= 562, false)::INT + (stamped <= 562)::INT + coalesce(stamped <= harvested, true)::INT + coalesce(year <= 2025, false)::INT + coalesce(562 - harvested <= 365, false)::INT) * 100.0 / 5, 2)::DOUBLE AS timeliness_score,
round((linked::INT + urls_fine::INT + apart::INT + licensed::INT + apart::INT) * 100.0 / 5, 2)::DOUBLE AS accessibility_score FROM g),
f AS (SELECT *, round(0.3::DOUBLE * completeness_score + 0.2::DOUBLE * validity_score + 0.15::DOUBLE * consistency_score + 0.15::DOUBLE * uniqueness_score + 0.1::DOUBLE * timeliness_score + 0.1::DOUBLE * accessibility_score, 2) AS final_score FROM s),
q AS (SELECT *, CASE WHEN final_score >= 90 THEN 'A' WHEN final_score >= 80 THEN 'B' WHEN final_score >= 70 THEN 'C' WHEN final_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM f)
"""
).replace("TITLE", _TIDY.format(HEADING)).replace("ABSTRACT", _TIDY.format("text"))


def _kinds(column: str):
    """Types of the issues in a list of messages."""
    return F.array_join(F.transform(column, S.issue_type), ",")


@query("d1_strongest_key", PUBLICATIONS + "SELECT key, min(publication_id) AS first_id, count(*) AS n FROM (SELECT publication_id, coalesce('doi:' || doi, 'id:' || source || ':' || publication_id) AS key FROM publications) GROUP BY key")
def strongest_key(spark, sf):
    p = publications(spark, sf)
    key = D.strongest_key(F.col("doi"), F.col("source"), F.col("publication_id").cast("string"), F.col("title"), F.col("publication_year"))
    return p.groupBy(key.alias("key")).agg(F.min("publication_id").alias("first_id"), F.count("*").alias("n"))


@query("d3_duplicate_accounting", PUBLICATIONS + "SELECT publication_id, CASE WHEN doi IS NULL OR row_number() OVER (PARTITION BY doi ORDER BY publication_id) = 1 THEN 'kept' ELSE 'duplicate' END AS action FROM publications")
def duplicate_accounting(spark, sf):
    return D.first_kept(publications(spark, sf).select("publication_id", "doi"), "doi", ["publication_id"]).select("publication_id", "action")


@query("d4_identity_match")
def identity_match(spark, sf):
    p = publications(spark, sf).withColumns({"external_id": F.concat(F.lit("x"), F.col("publication_id").cast("string")), "key_title": S.identity_title(F.col("title")), "first_author": F.col("author_id").cast("string")})
    k = F.col("publication_id")
    new = p.where(k % 50 == 0).select(
        k.alias("record_id"), F.when(k % 3 == 0, F.col("doi")).alias("doi"), "source", F.when(k % 3 == 1, F.col("external_id")).alias("external_id"),
        F.when(k % 4 == 0, F.concat("key_title", F.lit("s"))).otherwise(F.col("key_title")).alias("key_title"), "publication_year", "first_author",
    )
    return D.match(new, p)


def _profiles(spark, sf):
    """Records with class_id and profile_id, the least ids of those with the same text, and with the same of all that is scored.

    Equal titles and abstracts score 0.7: such records are one class. Without an abstract equal authors and
    years are asked for too.
    """
    r = full_records(spark, sf).select("publication_id", S.identity_title(F.col("title")).alias("key_title"), "abstract", "authors", "publication_year", S.doi(F.col("doi")).alias("doi"))
    text = F.sha2(F.concat_ws("|", F.coalesce("key_title", F.lit("")), F.coalesce("abstract", F.lit(""))), 256)
    facts = F.sha2(F.to_json(F.struct("authors", "publication_year")), 256)
    r = r.withColumns({"_p": F.concat(text, facts), "_c": F.when(F.col("abstract").isNull(), F.concat(text, facts)).otherwise(text)})
    least = r.groupBy("_c", "_p").agg(F.min("publication_id").alias("profile_id"))
    classes = least.groupBy("_c").agg(F.min("profile_id").alias("class_id"))
    return r.join(least, ["_c", "_p"]).join(classes, "_c").drop("_c", "_p")


@query("d7_duplicate_classes", QUALITY + """, p AS (SELECT r.k AS publication_id, coalesce(trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'), '[\\s\\x1c-\\x1f]+', ' ', 'g')), '') AS t, abstract AS a, year AS y,
CASE WHEN k % 19 = 0 THEN '' WHEN k % 23 = 0 THEN 'two' WHEN k % 53 = 0 THEN 'Aster' ELSE 'Author ' || k % 97 END AS w, abstract = '' AS bare FROM r)
SELECT publication_id, min(publication_id) OVER (PARTITION BY t, a, w, y) AS profile_id, min(publication_id) OVER (PARTITION BY t, a, CASE WHEN bare THEN w END, CASE WHEN bare THEN y END) AS class_id FROM p""".replace("\\\\", "\\"))
def duplicate_classes(spark, sf):
    """Whose text, and whose record, each record repeats: links of copies follow from these."""
    return _profiles(spark, sf).select("publication_id", "profile_id", "class_id")


@query("d7_duplicate_pairs")
def duplicate_pairs(spark, sf):
    """Links between different texts, by the least id of each profile; those within a class are in d7_duplicate_classes."""
    return D.duplicate_pairs(_profiles(spark, sf).where("publication_id = profile_id").drop("profile_id"))


@query("d9_author_resolution", "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN c_custkey::VARCHAR ELSE left(sha256('customer#' || lpad((o_custkey * 2)::VARCHAR, 9, '0')), 32) END AS author_id, c_custkey IS NULL AS is_new FROM orders LEFT JOIN customer ON lower(c_name) = 'customer#' || lpad((o_custkey * 2)::VARCHAR, 9, '0')")
def author_resolution(spark, sf):
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
    dimension = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("author_id"), F.lower("c_name").alias("normalized_name"))
    out = D.resolved(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), dimension, [S.identity(name)], ["normalized_name"], "author_id")
    return out.select("o_orderkey", "author_id", F.col("_new").alias("is_new"))


@query("d14_missing_links", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 2 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = lineitem.l_orderkey AND b.l_partkey = lineitem.l_partkey AND b.l_linenumber <= 2)")
def missing_links(spark, sf):
    links = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return D.missing_links(links.where("l_linenumber > 2"), links.where("l_linenumber <= 2"), ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_partkey")


@query("d5_tombstones", PUBLICATIONS + "SELECT coalesce(publication_id, gone) AS publication_id, coalesce(gone IS NOT NULL OR is_deleted, false) AS is_deleted FROM (SELECT publication_id, is_deleted FROM publications) FULL JOIN (SELECT DISTINCT l_orderkey * 3 AS gone FROM lineitem WHERE l_partkey % 10 = 0) ON publication_id = gone")
def tombstones(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_partkey % 10 = 0").select((F.col("l_orderkey") * 3).alias("publication_id"))
    return D.tombstoned(publications(spark, sf).select("publication_id", "is_deleted"), gone, "publication_id").select("publication_id", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"))


@query("d17_checksum_duplicates", "SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY sha256(text)) < doc_id THEN (min(doc_id) OVER (PARTITION BY sha256(text)))::VARCHAR END AS duplicate_of FROM documents")
def checksum_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("f"))
    return d.join(first, "h").select("doc_id", F.when(F.col("f") < F.col("doc_id"), F.col("f").cast("string")).alias("duplicate_of"))


@query("k1_upsert", PUBLICATIONS + """SELECT coalesce(o.publication_id, n.publication_id) AS publication_id, CASE WHEN o.publication_id IS NULL THEN 'created' WHEN n.publication_id IS NULL THEN 'kept' WHEN o.language IS DISTINCT FROM n.language OR o.doi IS DISTINCT FROM coalesce(n.doi, o.doi) THEN 'updated' ELSE 'unchanged' END AS action,
CASE WHEN n.publication_id IS NULL THEN o.language ELSE n.language END AS language, coalesce(n.doi, o.doi) AS doi
FROM (SELECT publication_id, language, doi FROM publications WHERE publication_id % 4 <> 0) o FULL JOIN (SELECT publication_id, CASE WHEN publication_id % 6 = 1 THEN 'om' ELSE language END AS language, CASE WHEN publication_id % 7 = 0 THEN NULL ELSE doi END AS doi FROM publications WHERE publication_id % 3 <> 0) n USING (publication_id)""")
def upsert(spark, sf):
    p, k = publications(spark, sf).select("publication_id", "language", "doi"), F.col("publication_id")
    new = p.where(k % 3 != 0).select(k, F.when(k % 6 == 1, "om").otherwise(F.col("language")).alias("language"), F.when(k % 7 != 0, F.col("doi")).alias("doi"))
    return D.upserted(p.where(k % 4 != 0), new, "publication_id", ["language", "doi"], keep=("doi",))


@query("k3_report_history", """WITH old AS (SELECT c_custkey AS id, round(c_acctbal, 0)::BIGINT % 5 AS grade, c_custkey % 3 <> 0 AS cur FROM customer), new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 9 ELSE round(c_acctbal, 0)::BIGINT % 5 END AS grade FROM customer WHERE c_custkey % 5 <> 0)
SELECT id, grade, 1 AS at, false AS is_current FROM old WHERE NOT cur
UNION ALL SELECT o.id, o.grade, 1, n.id IS NULL OR n.grade IS NOT DISTINCT FROM o.grade FROM old o LEFT JOIN new n USING (id) WHERE cur
UNION ALL SELECT n.id, n.grade, 2, true FROM new n LEFT JOIN old o ON o.id = n.id AND cur WHERE o.id IS NULL OR o.grade IS DISTINCT FROM n.grade""")
def report_history(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    score = F.round("c_acctbal", 0).cast("long") % 5
    old = c.select(k.alias("id"), score.alias("grade"), F.lit(1).alias("at"), (k % 3 != 0).alias("is_current"))
    new = c.where(k % 5 != 0).select(k.alias("id"), F.when(k % 2 == 0, F.lit(9)).otherwise(score).alias("grade"), F.lit(2).alias("at"))
    return D.current_reports(old, new, "id", ["grade"], "at")


@query("n4_validation", QUALITY + "SELECT publication_id AS doc_id, NOT list_contains(missing, 'title') AS valid, (list_contains(missing, 'title')::INT + list_contains(missing, 'external_id')::INT + list_contains(missing, 'authors')::INT)::INT AS issues FROM q")
def validation(spark, sf):
    """A record without a title or an external id is invalid; one without authors is warned of."""
    v = D.validated(full_records(spark, sf), {"title": F.col("title").isNull()}, {"external_id": F.col("external_id").isNull(), "authors": F.size("authors") == 0})
    return v.select(F.col("publication_id").alias("doc_id"), "valid", F.size("issues").alias("issues"))


_SCORES = ", ".join(f"{d}_score" for d in Q.WEIGHTS)


@query("q7_assessment", QUALITY + f"SELECT publication_id, {_SCORES}, final_score, grade, array_to_string(missing, ',') AS missing, array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings FROM q")
def assessment(spark, sf):
    return Q.assessed(full_records(spark, sf), AS_OF).select("publication_id", *[f"{d}_score" for d in Q.WEIGHTS], "final_score", "grade", F.array_join("missing_fields", ",").alias("missing"), _kinds("validation_errors").alias("errors"), _kinds("warnings").alias("warnings"))


@query("q1_completeness", QUALITY + "SELECT publication_id, completeness_score FROM q")
def completeness(spark, sf):
    return Q.assessed(full_records(spark, sf), AS_OF).select("publication_id", "completeness_score")


@query("q2_validity", QUALITY + "SELECT publication_id, validity_score FROM q")
def validity(spark, sf):
    return Q.assessed(full_records(spark, sf), AS_OF).select("publication_id", "validity_score")


@query("q3_consistency", QUALITY + "SELECT publication_id, consistency_score FROM q")
def consistency(spark, sf):
    return Q.assessed(full_records(spark, sf), AS_OF).select("publication_id", "consistency_score")


@query("q4_uniqueness", QUALITY + "SELECT publication_id, uniqueness_score FROM q")
def uniqueness(spark, sf):
    return Q.assessed(full_records(spark, sf), AS_OF).select("publication_id", "uniqueness_score")


@query("q5_timeliness", QUALITY + "SELECT publication_id, timeliness_score FROM q")
def timeliness(spark, sf):
    return Q.assessed(full_records(spark, sf), AS_OF).select("publication_id", "timeliness_score")


@query("q6_accessibility", QUALITY + "SELECT publication_id, accessibility_score FROM q")
def accessibility(spark, sf):
    return Q.assessed(full_records(spark, sf), AS_OF).select("publication_id", "accessibility_score")


@query("q8_recalculation", QUALITY + "SELECT publication_id, final_score FROM q WHERE publication_id % 17 <> 0")
def recalculation(spark, sf):
    """All that aren't deleted, in one pass."""
    return Q.assessed(full_records(spark, sf).where("not is_deleted"), AS_OF).select("publication_id", "final_score")


@query("q10_issues", QUALITY + """, i AS (SELECT 'missing_field' AS category, 'missing_' || unnest(missing) AS issue_type FROM q UNION ALL SELECT 'validation_error', unnest(errors) FROM q UNION ALL SELECT 'warning', unnest(warnings) FROM q
UNION ALL SELECT 'recommendation', CASE WHEN m = 'harvested_at' THEN 'persist_harvested_at_for_provenance' ELSE 'provide_' || m || '_metadata' END FROM (SELECT unnest(missing) AS m FROM q)) SELECT category, issue_type, count(*) AS n FROM i GROUP BY ALL""")
def issue_rows(spark, sf):
    return Q.issues(Q.assessed(full_records(spark, sf), AS_OF), "publication_id").groupBy("category", "issue_type").agg(F.count("*").alias("n"))


@query("q11_low_quality_reports", QUALITY + "SELECT publication_id, final_score, grade FROM q WHERE final_score <= 70")
def low_quality_reports(spark, sf):
    return Q.assessed(full_records(spark, sf), AS_OF).where("final_score <= 70").select("publication_id", "final_score", "grade")
