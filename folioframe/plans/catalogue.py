"""Catalogue queries: filters, joins, aggregates, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as P
from ..operators import ranking as W
from .registry import query
from .views import CONNECTORS, PUBLICATIONS, authors, connectors, keyword_links, keywords, publications, table


@query("p1_university_filter", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(n_name) LIKE '%a%' AND r_name IN ('ASIA', 'AFRICA')")
def universities(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.facets(n, text={"n_name": "A"}).where(F.col("r_name").isin("ASIA", "AFRICA")).select("n_nationkey", "n_name", "r_name")


@query("p2_repository_filter", "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE lower(s_name) LIKE '%1%' AND s_nationkey = 7")
def repositories(spark, sf):
    return P.facets(table(spark, sf, "supplier"), equal={"s_nationkey": 7}, text={"s_name": "1"}).select("s_suppkey", "s_name", "s_nationkey")


@query("p3_author_filter", "SELECT c_custkey AS author_id, c_name AS full_name FROM customer WHERE lower(c_name) LIKE '%00%' AND c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def author_filter(spark, sf):
    return P.facets(authors(spark, sf), equal={"university_id": 3, "department": "BUILDING"}, text={"full_name|normalized_name": "00"}).select("author_id", "full_name")


@query("p4_keyword_filter", "SELECT p_partkey AS keyword_id, p_name AS term FROM part WHERE lower(p_name) LIKE '%1%' AND p_size BETWEEN 10 AND 30")
def keyword_filter(spark, sf):
    return P.facets(table(spark, sf, "part"), text={"p_name": "1"}, low={"p_size": 10}, high={"p_size": 30}).select(F.col("p_partkey").alias("keyword_id"), F.col("p_name").alias("term"))


@query("p5_journal_filter", "SELECT p_brand, count(*) AS n FROM part WHERE lower(p_brand) LIKE '%brand#1%' GROUP BY p_brand")
def journal_filter(spark, sf):
    return P.facets(table(spark, sf, "part"), text={"p_brand": "Brand#1"}).groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    "p6_publication_facets",
    PUBLICATIONS
    + """SELECT publication_id, title, publication_year FROM publications p
WHERE source_type = 'journal' AND language = 'en' AND publication_year BETWEEN 1994 AND 1996 AND NOT is_deleted
  AND (lower(title) LIKE '%urgent%' OR lower(abstract) LIKE '%urgent%')
  AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = author_id AND lower(c_name) LIKE '%1%')
  AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = publication_id AND p_size <= 25)""",
)
def publication_facets(spark, sf):
    p = P.facets(publications(spark, sf), equal={"source_type": "journal", "language": "en", "is_deleted": False}, text={"title|abstract": "urgent"}, low={"publication_year": 1994}, high={"publication_year": 1996})
    p = p.join(authors(spark, sf).where(P.contains("full_name", "1")).select("author_id"), "author_id", "left_semi")
    k = table(spark, sf, "part").select(F.col("p_partkey").alias("keyword_id"), "p_size")
    return P.having(p, keyword_links(spark, sf), k, F.col("p_size") <= 25, on="publication_id", link="keyword_id").select("publication_id", "title", "publication_year")


@query("p7_harvest_jobs", "SELECT event_id, event_type FROM events WHERE year(ts) = 2024 AND event_type IN ('error', 'purchase') AND month(ts) <= 6")
def harvest_jobs(spark, sf):
    e = table(spark, sf, "events")
    return e.where((F.year("ts") == 2024) & F.col("event_type").isin("error", "purchase") & (F.month("ts") <= 6)).select("event_id", "event_type")


@query("p11_chunk_interval", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3 AND coalesce(CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_linenumber + 2 END, l_linenumber) >= 3")
def chunk_interval(spark, sf):
    n = F.col("l_linenumber")
    chunks = table(spark, sf, "lineitem").select("l_orderkey", n, n.alias("page_start"), F.when(n % 2 == 0, F.lit(None)).otherwise(n + 2).alias("page_end"))
    return P.page_interval(chunks, 3).select("l_orderkey", "l_linenumber")


@query("p11_json_predicate", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90")
def json_predicate(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").where(k >= 90).select("event_id", k.alias("k"))


@query("p12_journal_branch", PUBLICATIONS + "SELECT publication_id, is_deleted FROM publications WHERE source_type = 'journal' AND lower(title) LIKE '%high%'")
def journal_branch(spark, sf):
    """The journal facet alone does not leave out deleted rows; kept as it is."""
    return P.facets(publications(spark, sf), equal={"source_type": "journal"}, text={"title": "high"}).select("publication_id", "is_deleted")


@query(
    "p13_full_text",
    r"""SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), ['the', 'that', 'from'])""",
)
def full_text(spark, sf):
    return table(spark, sf, "documents").where(P.all_tokens(F.col("text"), "The that FROM")).select("doc_id")


@query("p14_any_token", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'apache')")
def any_token(spark, sf):
    return table(spark, sf, "documents").where(P.any_token(["text"], "License of Apache")).select("doc_id")


@query(
    "p15_institution_scope",
    PUBLICATIONS + "SELECT publication_id FROM publications WHERE repository_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR author_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)",
)
def institution_scope(spark, sf):
    p = publications(spark, sf)
    by_repository = p.join(F.broadcast(table(spark, sf, "nation").where("n_regionkey = 1")), F.col("repository_id") == F.col("n_nationkey"), "left_semi").select("publication_id")
    by_author = p.join(table(spark, sf, "customer").where("c_nationkey = 5"), F.col("author_id") == F.col("c_custkey"), "left_semi").select("publication_id")
    return by_repository.union(by_author).distinct()


@query("p19_marker_predicate", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND NOT contains(lower(coalesce(text, '')), 'ignore previous')")
def marker_predicate(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where(P.contains("text", "the") & ~P.has_marker(F.col("text"), ("ignore previous",))).select("conv_id", "turn")


@query("p20_low_quality", PUBLICATIONS + "SELECT publication_id, quality_score FROM publications WHERE quality_score <= least(80, 70) AND NOT is_deleted")
def low_quality(spark, sf):
    return P.facets(publications(spark, sf), equal={"is_deleted": False}, high={"quality_score": min(80, 70)}).select("publication_id", "quality_score")


@query("p21_public_url", r"SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://[^/\s?#]+') THEN url END AS public_url FROM pages")
def public_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.public_url(F.col("url")).alias("public_url"))


@query(
    "p22_response",
    """SELECT l_orderkey AS publication_id, string_agg(p_name, ';' ORDER BY l_linenumber, p_name) AS keywords, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
)
def response(spark, sf):
    links = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name")))
    return links.groupBy(F.col("l_orderkey").alias("publication_id")).agg(F.array_join(F.transform(ordered, lambda x: x["p_name"]), ";").alias("keywords"), F.count("*").alias("n"))


@query("s20_incremental_window", PUBLICATIONS + "SELECT publication_id FROM publications WHERE CAST(updated_at AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-09-30'")
def incremental(spark, sf):
    return P.window_of(publications(spark, sf), "updated_at", "1995-03-01", "1995-09-30").select("publication_id")


@query("j1_authors", PUBLICATIONS + "SELECT publication_id, c_name AS full_name FROM publications JOIN customer ON author_id = c_custkey WHERE NOT is_deleted")
def join_authors(spark, sf):
    return P.facets(publications(spark, sf), equal={"is_deleted": False}).join(authors(spark, sf), "author_id").select("publication_id", "full_name")


@query("j4_source_status", PUBLICATIONS + ", " + CONNECTORS + """SELECT code, replace(connector_type, '_', '-') AS type, enabled AND status = 'active' AS is_active, coalesce(n, 0)::BIGINT AS publications
FROM connectors LEFT JOIN (SELECT source, count(*) AS n FROM publications GROUP BY source) ON source = code""")
def source_status(spark, sf):
    counted = publications(spark, sf).groupBy(F.col("source").alias("code")).agg(F.count("*").alias("n"))
    c = connectors(spark, sf).join(counted, "code", "left")
    return c.select("code", F.translate("connector_type", "_", "-").alias("type"), (F.col("enabled") & (F.col("status") == "active")).alias("is_active"), F.coalesce("n", F.lit(0)).alias("publications"))


@query("j5_document_detail", """SELECT c_custkey, count(o_orderkey) AS chunks, coalesce(sum(o_totalprice), 0)::DOUBLE AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS embedded, max(o_orderpriority) AS model
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def document_detail(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.max("o_orderpriority").alias("model"))
    zero = F.lit(0)
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", zero).alias("chunks"), F.coalesce("s", F.lit(0.0)).alias("total"), F.coalesce("f", zero).alias("embedded"), "model")


@query("j7_without_link", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def without_link(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("j12_composite", PUBLICATIONS + "SELECT a.publication_id AS first_id, b.publication_id AS second_id FROM publications a JOIN publications b ON a.doi = b.doi AND a.publication_year = b.publication_year AND a.author_id = b.author_id AND a.publication_id < b.publication_id")
def composite(spark, sf):
    p = publications(spark, sf).where("doi is not null and publication_year is not null").select("publication_id", "doi", "publication_year", "author_id")
    a, b = p.withColumnRenamed("publication_id", "first_id"), p.withColumnRenamed("publication_id", "second_id")
    return a.join(b, ["doi", "publication_year", "author_id"]).where("first_id < second_id").select("first_id", "second_id")


@query("j15_manifest_join", r"SELECT page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS base, d.doc_id::VARCHAR AS doc_id FROM pages LEFT JOIN documents d ON d.doc_id::VARCHAR = regexp_extract(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '^[0-9]+')")
def manifest_join(spark, sf):
    base = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    p = table(spark, sf, "pages").select("page_id", base.alias("base"), F.regexp_extract(base, "^[0-9]+", 0).alias("key"))
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    return p.join(d, "key", "left").select("page_id", "base", F.col("doc_id").cast("string").alias("doc_id"))


@query("a1_counts", PUBLICATIONS + "SELECT count(*) AS total, count(*) FILTER (WHERE is_deleted) AS deleted FROM publications")
def counts(spark, sf):
    return publications(spark, sf).agg(F.count("*").alias("total"), F.count_if("is_deleted").alias("deleted"))


@query("a2_trends", PUBLICATIONS + "SELECT publication_year, count(*) AS n FROM publications WHERE publication_year IS NOT NULL GROUP BY 1")
def trends(spark, sf):
    return publications(spark, sf).where("publication_year is not null").groupBy("publication_year").agg(F.count("*").alias("n")).orderBy("publication_year")


@query("a3_trend_overview", PUBLICATIONS + "SELECT publication_year, count(*) AS n FROM publications WHERE NOT is_deleted AND publication_year >= 1994 GROUP BY 1")
def trend_overview(spark, sf):
    return P.facets(publications(spark, sf), equal={"is_deleted": False}, low={"publication_year": 1994}).groupBy("publication_year").agg(F.count("*").alias("n"))


@query("a4_keyword_trends", "SELECT p_name AS term, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, term LIMIT 25")
def keyword_trends(spark, sf):
    counted = keyword_links(spark, sf).groupBy("keyword_id").agg(F.count("*").alias("k"))  # before the join: one row a keyword
    return counted.join(keywords(spark, sf), "keyword_id").groupBy("term").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "term").limit(25)


@query("a6_source_statistics", PUBLICATIONS + "SELECT source, count(*) AS total, count(*) FILTER (WHERE is_deleted) AS deleted, count(*) - count(*) FILTER (WHERE is_deleted) AS active FROM publications GROUP BY source")
def source_statistics(spark, sf):
    g = publications(spark, sf).groupBy("source").agg(F.count("*").alias("total"), F.count_if("is_deleted").alias("deleted"))
    return g.withColumn("active", F.col("total") - F.col("deleted"))


@query("a7_job_activity", "SELECT user_id % 50 AS source, count(*) AS jobs, count(*) FILTER (WHERE event_type IN ('signup', 'click')) AS active, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def job_activity(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("source"))
    return e.agg(F.count("*").alias("jobs"), F.count_if(F.col("event_type").isin("signup", "click")).alias("active"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"))


@query("a8_quality_summary", PUBLICATIONS + """SELECT CASE WHEN quality_score >= 90 THEN 'A' WHEN quality_score >= 80 THEN 'B' WHEN quality_score >= 70 THEN 'C' WHEN quality_score >= 60 THEN 'D' ELSE 'F' END AS grade,
count(*) AS n, round(avg(quality_score), 2) AS mean, count(*) FILTER (WHERE is_deleted) AS deleted FROM publications GROUP BY 1""")
def quality_summary(spark, sf):
    return publications(spark, sf).groupBy(S.grade(F.col("quality_score")).alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 2).alias("mean"), F.count_if("is_deleted").alias("deleted"))


@query("a9_embedding_status", PUBLICATIONS + "SELECT count(*) AS total, count(abstract) AS embedded, count(*) - count(abstract) AS missing, count(*) FILTER (WHERE abstract IS NOT NULL AND quality_score IS NULL) AS stale FROM publications WHERE NOT is_deleted")
def embedding_status(spark, sf):
    p = publications(spark, sf).where(~F.col("is_deleted"))
    return p.agg(F.count("*").alias("total"), F.count("abstract").alias("embedded"), F.count_if(F.col("abstract").isNull()).alias("missing"), F.count_if(F.col("abstract").isNotNull() & F.col("quality_score").isNull()).alias("stale"))


@query("a12_run_report", "SELECT user_id % 10 AS run, count(*) AS seen, count(*) FILTER (WHERE event_type = 'signup') AS imported, count(*) FILTER (WHERE event_type = 'view') AS updated, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def run_report(spark, sf):
    kinds = {"imported": "signup", "updated": "view", "errors": "error"}
    return table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("run")).agg(F.count("*").alias("seen"), *[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])


@query("a13_combined_report", "SELECT count(DISTINCT user_id % 10) AS runs, count(*) AS seen, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def combined_report(spark, sf):
    r = run_report(spark, sf)
    return r.agg(F.count("*").alias("runs"), F.sum("seen").alias("seen"), F.sum("errors").alias("errors"))


@query("a14_counters", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1")
def counters(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"))


@query("a16_manifest_statistics", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY 1")
def manifest_statistics(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))


@query("a19_grounding", """SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'assistant') >= 3 AND max(length(text)) >= 65 THEN 'strong' WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN 'partial' ELSE 'insufficient' END AS grounding
FROM conversations GROUP BY conv_id""")
def grounding(spark, sf):
    said = F.count_if(F.col("role") == "assistant")
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(said.alias("n"), F.max(F.length("text")).alias("most"))
    return g.select("conv_id", F.when((F.col("n") >= 3) & (F.col("most") >= 65), "strong").when(F.col("n") > 0, "partial").otherwise("insufficient").alias("grounding"))


@query("a21_term_frequency", r"""SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term, unnest(range(len(regexp_extract_all(lower(text), '[a-z]{3,}')))) AS pos FROM documents) GROUP BY doc_id, term""")
def term_frequency(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    return S.each_count(S.counted(table(spark, sf, "documents").select("doc_id", words.alias("w")), "w"), ["doc_id"]).select("doc_id", "c.*")


@query("w1_latest_report", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_report(spark, sf):
    order = F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), F.col("o_orderkey").alias("k"))
    return W.best(table(spark, sf, "orders"), ["o_custkey"], order, ["o_orderkey"])


@query("w2_first_by_identity", PUBLICATIONS + "SELECT publication_id, doi FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(doi, source || ':' || publication_id) ORDER BY publication_id) AS r FROM publications) WHERE r = 1")
def first_by_identity(spark, sf):
    key = F.coalesce("doi", F.concat_ws(":", "source", F.col("publication_id").cast("string")))
    return W.best(publications(spark, sf).withColumn("k", key), ["k"], F.col("publication_id"), ["publication_id", "doi"]).drop("k")


@query("w3_year_pool", PUBLICATIONS + "SELECT publication_year::VARCHAR AS publication_year, publication_id FROM (SELECT *, row_number() OVER (PARTITION BY publication_year ORDER BY updated_at DESC, publication_id) AS r FROM publications WHERE NOT is_deleted) WHERE r <= 100")
def year_pool(spark, sf):
    p = publications(spark, sf).where(~F.col("is_deleted"))
    return W.top(p, ["publication_year"], [F.desc("updated_at"), F.col("publication_id")], 100).select(F.col("publication_year").cast("string").alias("publication_year"), "publication_id")


@query("w5_author_order", "SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_suppkey) AS author_order FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2)")
def author_order(spark, sf):
    first = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first"))
    return first.select("l_orderkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first", "l_suppkey")).cast("long").alias("author_order"))


@query("w6_changes", PUBLICATIONS + """SELECT publication_id, field, old_value, new_value FROM (
  SELECT publication_id, 'language' AS field, language AS old_value, CASE WHEN publication_id % 7 = 0 THEN 'om' ELSE language END AS new_value FROM publications
  UNION ALL SELECT publication_id, 'doi', doi, CASE WHEN publication_id % 10 = 0 THEN '10.1/new' ELSE doi END FROM publications) WHERE old_value IS DISTINCT FROM new_value""")
def changed(spark, sf):
    old = publications(spark, sf)
    k = F.col("publication_id")
    new = old.withColumns({"language": F.when(k % 7 == 0, "om").otherwise(F.col("language")), "doi": F.when(k % 10 == 0, "10.1/new").otherwise(F.col("doi"))})
    return W.changes(old, new, "publication_id", ["language", "doi"])


@query("w10_last_turns", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def last_turns(spark, sf):
    return W.top(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn")


@query("w12_failure_streak", """WITH j AS (SELECT user_id % 40 AS source, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'other' END AS status FROM events),
s AS (SELECT source, max(CASE WHEN status = 'completed' THEN ts END) AS last FROM j GROUP BY source)
SELECT s.source, epoch_us(last) AS last_us, count(*) FILTER (WHERE status = 'failed' AND (last IS NULL OR ts > last)) AS failures FROM s JOIN j USING (source) GROUP BY s.source, last""")
def failure_streak(spark, sf):
    jobs = table(spark, sf, "events").select((F.col("user_id") % 40).alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("other").alias("status"))
    return W.failure_streak(jobs, "source", "ts", "status").select("source", F.unix_micros("last_success").alias("last_us"), "failures")


@query("t1_page", PUBLICATIONS + "SELECT publication_id FROM publications ORDER BY updated_at DESC, publication_id LIMIT 500 OFFSET 100")
def paged(spark, sf):
    return P.page(publications(spark, sf).select("publication_id", "updated_at"), [F.desc("updated_at"), F.col("publication_id")], 9999, 100).select("publication_id")


@query("t3_selected_order", PUBLICATIONS + "SELECT publication_id, quality_score FROM publications ORDER BY quality_score DESC NULLS LAST, publication_id LIMIT 200")
def selected_order(spark, sf):
    p = publications(spark, sf).select("publication_id", "quality_score", "updated_at")
    return P.page(p, P.ordered(p, "quality_score", True, ("quality_score", "updated_at"), "updated_at", "publication_id"), 200).drop("updated_at")


@query("t7_keyset", PUBLICATIONS + "SELECT publication_id FROM publications WHERE publication_id > 1000 ORDER BY publication_id LIMIT 300")
def keyset(spark, sf):
    return publications(spark, sf).where("publication_id > 1000").select("publication_id").orderBy("publication_id").limit(300)


@query("t8_type_priority", "SELECT p_partkey FROM part ORDER BY CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, p_name, p_partkey LIMIT 100")
def type_priority(spark, sf):
    return table(spark, sf, "part").orderBy(F.col("p_size") % 4, "p_name", "p_partkey").limit(100).select("p_partkey")


@query("t10_top_terms", r"""SELECT doc_id, term, n FROM (SELECT doc_id, term, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS r
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term, unnest(range(len(regexp_extract_all(lower(text), '[a-z]{3,}')))) AS pos FROM documents) GROUP BY doc_id, term) WHERE r <= 5""")
def top_terms(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    counted = S.counted(table(spark, sf, "documents").select("doc_id", words.alias("w")), "w")
    return S.each_count(counted, ["doc_id"], S.most_common(F.col("_counts"), 5)).select("doc_id", "c.term", "c.n")


@query("u1_candidate_union", PUBLICATIONS + """SELECT publication_id, max(score) AS score FROM (SELECT publication_id, quality_score / 100 AS score FROM publications WHERE quality_score > 60 UNION ALL SELECT publication_id, 0.0 FROM publications WHERE language = 'am') GROUP BY 1""")
def candidate_union(spark, sf):
    p = publications(spark, sf)
    a = p.where("quality_score > 60").select("publication_id", (F.col("quality_score") / 100).alias("score"))
    return a.unionByName(p.where("language = 'am'").select("publication_id", F.lit(0.0).alias("score"))).groupBy("publication_id").agg(F.max("score").alias("score"))


@query("u3_uncovered", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def uncovered(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey")
    for covered in (o.where("o_orderstatus = 'O'"), o.where("o_totalprice > 300000")):
        c = c.join(covered.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c


def _parts_of_suppliers(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("s"))


_SETS = "WITH s AS (SELECT l_suppkey, list_distinct(list(l_partkey)) AS s FROM lineitem GROUP BY 1), p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, len(list_intersect(a.s, b.s)) AS n, len(a.s) AS x, len(b.s) AS y FROM s a JOIN s b ON a.l_suppkey + 1 = b.l_suppkey) "


def _neighbours(spark, sf):
    """The keyword sets of each two suppliers with neighbouring numbers."""
    s = _parts_of_suppliers(spark, sf)
    return s.select(F.col("l_suppkey").alias("a"), F.col("s").alias("x")).join(s.select(F.col("l_suppkey").alias("b"), (F.col("l_suppkey") - 1).alias("a"), F.col("s").alias("y")), "a")


@query("u5_jaccard", _SETS + "SELECT a, b, round(n / (x + y - n), 6) AS jaccard FROM p")
def jaccard(spark, sf):
    return _neighbours(spark, sf).select("a", "b", F.round(S.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("u4_overlap", _SETS + "SELECT a, b, round(n / least(x, y), 6) AS overlap FROM p")
def overlap(spark, sf):
    return _neighbours(spark, sf).select("a", "b", F.round(S.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("u6_distinct_fold", "SELECT k, arg_min(p_type, p_partkey) AS kept, count(*) AS n FROM (SELECT *, lower(p_type) AS k FROM part) GROUP BY 1")
def distinct_fold(spark, sf):
    """Values that are alike but for case, by their first spelling."""
    return table(spark, sf, "part").groupBy(F.lower("p_type").alias("k")).agg(F.min_by("p_type", "p_partkey").alias("kept"), F.count("*").alias("n"))


@query("u7_first_url", r"SELECT regexp_replace(url, '[?#].*$', '') AS address, min(page_id) AS page_id FROM pages GROUP BY 1")
def first_url(spark, sf):
    return table(spark, sf, "pages").groupBy(F.regexp_replace("url", "[?#].*$", "").alias("address")).agg(F.min("page_id").alias("page_id"))
