"""Normalisation, imports, sinks, resolution and streams over derived pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as P
from ..operators import identity as D
from ..operators import quality as Q
from ..operators import ranking as W
from ..operators import sinks as K
from ..sources import canonical as C
from ..sources import records as X
from ..streaming import ingest
from .records import AS_OF, full_records
from .registry import query
from .sources import _hal_pages, _oai_pages, folder
from .views import PUBLICATIONS, publications, table

_TITLE = r"nullif(regexp_replace(trim(regexp_replace(regexp_extract(text, '^[^.!?\n]*'), '\s+', ' ', 'g')), '[ /:]+$', ''), '')"


def _canonical(spark, sf):
    return C.canonical(X.oai_records(_oai_pages(spark, sf)).withColumn("m", X.multimap(F.col("fields"))))


@query("n1_canonical", f"SELECT 'oai:x:' || doc_id AS external_id, CASE WHEN doc_id % 17 <> 0 THEN {_TITLE} END AS title, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 2 END::INT AS authors, CASE WHEN doc_id % 17 <> 0 THEN lang END AS language, doc_id % 17 = 0 AS is_deleted FROM documents")
def canonical(spark, sf):
    return _canonical(spark, sf).select("external_id", "title", F.size("authors").alias("authors"), "language", "is_deleted")


@query("n2_import_mapping", r"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'dc ' || doc_id WHEN 1 THEN 'plain ' || doc_id WHEN 2 THEN 'named ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN '2019' END AS publication_year, doc_id % 4 = 3 AS bad FROM documents")
def import_mapping(spark, sf):
    k = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"dc.title": [{"value": "dc '), k, F.lit('"}], "name": "x", "year": "c2019 2019"}'))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"title": " plain  '), k, F.lit(' "}'))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"name": "named '), k, F.lit('", "year": 2019}'))).otherwise(F.lit('{"uuid": "u"}'))
    out = C.imported(table(spark, sf, "documents").select("doc_id", raw.alias("raw")))
    return out.select("doc_id", "title", F.col("publication_year").cast("string").alias("publication_year"), F.col("error").isNotNull().alias("bad"))


@query("n6_file_checks", "SELECT page_id, CASE WHEN length(html) > 4000 THEN 'large' WHEN min(page_id) OVER (PARTITION BY sha256(html)) < page_id THEN 'duplicate' ELSE 'accepted' END AS state FROM pages")
def file_checks(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.length("html").alias("n"), F.sha2("html", 256).alias("h"))
    first = p.groupBy("h").agg(F.min("page_id").alias("first"))
    return p.join(first, "h").select("page_id", F.when(F.col("n") > 4000, "large").when(F.col("first") < F.col("page_id"), "duplicate").otherwise("accepted").alias("state"))


@query("s2_headers", "SELECT 'oai:x:' || doc_id AS identifier, source AS set_spec, doc_id % 17 = 0 AS deleted FROM documents")
def headers(spark, sf):
    return X.oai_records(_oai_pages(spark, sf)).select("identifier", F.get("sets", F.lit(0)).alias("set_spec"), "deleted")


@query("s4_error_routing", "SELECT CASE doc_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'permanent' WHEN 2 THEN 'transient' END AS error_class, count(*) AS n FROM documents GROUP BY 1")
def error_routing(spark, sf):
    code = F.when(F.col("doc_id") % 4 == 0, "noRecordsMatch").when(F.col("doc_id") % 4 == 1, "badArgument").otherwise("serviceUnavailable")
    xml = F.when(F.col("doc_id") % 4 < 3, F.concat(F.lit('<OAI-PMH><error code="'), code, F.lit('">x</error></OAI-PMH>'))).otherwise(F.lit("<OAI-PMH><ListRecords/></OAI-PMH>"))
    return X.oai_page_state(table(spark, sf, "documents").select(xml.alias("xml"))).groupBy("error_class").agg(F.count("*").alias("n"))


@query("s8_public_items", "SELECT doc_id::VARCHAR AS identifier FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0")
def public_items(spark, sf):
    return X.dspace_items(_hal_pages(spark, sf), public_only=True).select("identifier")


@query("s10_multimap", "SELECT 'oai:x:' || doc_id AS identifier, 'A ' || (doc_id % 9) AS first_creator, 2 AS creators FROM documents WHERE doc_id % 17 <> 0")
def multimap(spark, sf):
    r = X.oai_records(_oai_pages(spark, sf)).where("not deleted").withColumn("m", X.multimap(F.col("fields")))
    return r.select("identifier", F.col("m")["creator"][0].alias("first_creator"), F.size(F.col("m")["creator"]).alias("creators"))


@query("s15_validated_list", "SELECT n_nationkey, CASE WHEN length(n_name) < 6 THEN 'short' END AS violation FROM nation")
def validated_list(spark, sf):
    v = D.validated(table(spark, sf, "nation"), {"short": F.length("n_name") < 6}, {})
    return v.select("n_nationkey", F.get("issues", F.lit(0))["field"].alias("violation"))


@query("s21_capped_scan", PUBLICATIONS + "SELECT publication_id FROM publications WHERE NOT is_deleted ORDER BY publication_id LIMIT 400")
def capped_scan(spark, sf):
    return publications(spark, sf).where(~F.col("is_deleted")).orderBy("publication_id").limit(400).select("publication_id")


@query("s22_undated_kept", PUBLICATIONS + "SELECT publication_id FROM publications WHERE publication_id % 6 = 0 OR CAST(updated_at AS DATE) >= DATE '1997-01-01'")
def undated_kept(spark, sf):
    p = publications(spark, sf).withColumn("updated_at", F.when(F.col("publication_id") % 6 != 0, F.col("updated_at")))
    return P.window_of(p, "updated_at", "1997-01-01", keep_undated=True).select("publication_id")


@query("k2_history", PUBLICATIONS + "SELECT publication_id, 'language' AS field, language AS old_value, 'om' AS new_value FROM publications WHERE publication_id % 9 = 0 UNION ALL SELECT publication_id, 'language', 'om', 'ti' FROM publications WHERE publication_id % 9 = 0")
def history(spark, sf):
    """Two runs of changes appended and read back."""
    path, p = folder(spark, "history"), publications(spark, sf).select("publication_id", "language")
    one = p.withColumn("language", F.when(F.col("publication_id") % 9 == 0, "om").otherwise(F.col("language")))
    two = one.withColumn("language", F.when(F.col("publication_id") % 9 == 0, "ti").otherwise(F.col("language")))
    K.append_history(W.changes(p, one, "publication_id", ["language"]), path, "2024-01-01")
    K.append_history(W.changes(one, two, "publication_id", ["language"]), path, "2024-01-02")
    return spark.read.parquet(path).select("publication_id", "field", "old_value", "new_value")


@query("k7_quarantine", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 0")
def quarantine(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "bad").alias("error"))
    return K.split_errors(rows, folder(spark, "quarantine"))


_CITED = """WITH c AS (SELECT o_custkey AS key, min(o_orderkey) AS at, arg_max(o_orderpriority, o_orderkey) AS title, arg_max(year(o_orderdate), o_orderkey) AS year, max(o_orderkey) AS last FROM orders GROUP BY 1),
t AS (SELECT *, ['Ada N' || key % 3, 'Bo'] AS authors, 'https://x.org/' || last AS url FROM c) """


def _cited(spark, sf):
    k = F.col("o_custkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), k.alias("key"), F.col("o_orderpriority").alias("title"), F.array(F.concat(F.lit("Ada N"), (k % 3).cast("string")), F.lit("Bo")).alias("authors"), F.year("o_orderdate").alias("year"), F.lit(None).cast("string").alias("doi"), F.concat(F.lit("https://x.org/"), F.col("o_orderkey").cast("string")).alias("url"))


@query("k9_ris_export", _CITED + "SELECT line, count(*) AS n FROM (SELECT unnest(['TY  - GEN', 'AU  - ' || authors[1], 'AU  - Bo', 'TI  - ' || title, 'PY  - ' || year, 'UR  - ' || url, 'ER  -']) AS line FROM t) GROUP BY 1")
def ris_export(spark, sf):
    """Each source once, written as RIS; the lines of the files."""
    path = folder(spark, "ris")
    K.exported(_cited(spark, sf), "ris", path)
    return spark.read.text(path).where("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("k9_bibtex_export", _CITED + "SELECT line, count(*) AS n FROM (SELECT unnest(['@misc{N' || key % 3 || year || ',', '  author = {' || authors[1] || ' and Bo},', '  title = {' || title || '},', '  year = {' || year || '},', '  url = {' || url || '}', '}']) AS line FROM t) GROUP BY 1")
def bibtex_export(spark, sf):
    path = folder(spark, "bibtex")
    K.exported(_cited(spark, sf), "bibtex", path)
    return spark.read.text(path).where("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("k8_record_export", "SELECT min(doc_id) AS doc_id, min(n_chars)::BIGINT AS n_chars FROM documents WHERE n_chars IS NOT NULL GROUP BY source, n_chars")
def record_export(spark, sf):
    """Records written as JSON with the later ones of a key left out, read again."""
    path = folder(spark, "export")
    d = table(spark, sf, "documents").where("n_chars is not null").select("doc_id", "n_chars", F.concat_ws("|", "source", F.col("n_chars").cast("string")).alias("key"))
    K.exported_records(d, path, "key", "doc_id")
    return spark.read.schema("doc_id bigint, n_chars bigint, key string").json(path).select("doc_id", "n_chars")


@query("k10_job_summary", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS bytes FROM events GROUP BY 1")
def job_summary(spark, sf):
    return K.summary(table(spark, sf, "events"), "event_type", "event_id")


@query("r18_registry", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer")
def document_registry(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    old = c.select(k.alias("id"), F.when(k % 2 == 0, F.col("c_name")).alias("name"))
    new = c.select(k.alias("id"), F.when(k % 3 == 0, "new").otherwise("  ").alias("name"))
    return K.registry(old, new, "id", ["name"])


@query("d11_journal_resolution", "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN 'B' || p_brand END, left(sha256(lower(p_brand || ' journal')), 32)) AS journal_id FROM part")
def journal_resolution(spark, sf):
    p = table(spark, sf, "part")
    dimension = p.select(F.concat(F.lit("B"), "p_brand").alias("journal_id"), F.concat(F.lit("issn-"), "p_brand").alias("issn"), F.lit(None).cast("string").alias("normalized_name")).distinct()
    keys = [F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("issn-"), "p_brand")), S.identity(F.concat("p_brand", F.lit(" Journal")))]
    return D.resolved(p.select("p_partkey", "p_brand", "p_size"), dimension, keys, ["issn", "normalized_name"], "journal_id").select("p_partkey", "journal_id")


@query("d16_university_import", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'created' WHEN n_nationkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM nation")
def university_import(spark, sf):
    n, k = table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey")
    new = n.withColumn("n_name", F.when(k % 3 == 0, F.concat("n_name", F.lit(" II"))).otherwise(F.col("n_name")))
    return D.upserted(n.where(k % 5 != 0), new, "n_nationkey", ["n_name"]).select("n_nationkey", "action")


@query("st1_incremental", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def incremental(spark, sf):
    """Drained twice with one checkpoint: the second call finds nothing new."""
    out, mark = folder(spark, "landed"), folder(spark, "mark")
    schema = table(spark, sf, "events").schema
    for _ in range(2):
        ingest.drain(ingest.landed(spark, f"{sf}/event[s].parquet", schema), mark, ingest.appended(out))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("st4_tombstone_order", "SELECT user_id, event_type = 'error' AS is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def tombstone_order(spark, sf):
    """The newest row of a key decides, in whatever order the halves come."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "error").alias("is_deleted"))
    later = ingest.latest_state(e.where("event_id % 2 = 1"), None, "user_id", "ts")
    return ingest.latest_state(e.where("event_id % 2 = 0"), later, "user_id", "ts").select("user_id", "is_deleted")
