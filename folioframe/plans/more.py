"""Further catalogue, resolution, quality and retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as P
from ..operators import identity as D
from ..operators import quality as Q
from ..operators import ranking as W
from ..operators import retrieval as R
from .records import AS_OF, full_records
from .registry import query
from .views import PUBLICATIONS, connectors, heading, keyword_links, publications, table


@query("p8_quality_filter", PUBLICATIONS + "SELECT publication_id FROM publications JOIN nation ON repository_id = n_nationkey WHERE quality_score BETWEEN 20 AND 60 AND n_regionkey = 2 AND publication_year = 1995 AND NOT is_deleted")
def quality_filter(spark, sf):
    p = P.facets(publications(spark, sf), equal={"publication_year": 1995, "is_deleted": False}, low={"quality_score": 20}, high={"quality_score": 60})
    return p.join(F.broadcast(table(spark, sf, "nation").where("n_regionkey = 2")), F.col("repository_id") == F.col("n_nationkey"), "left_semi").select("publication_id")


@query("p9_source_list", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 AND s_nationkey IN (1, 2, 3)")
def source_list(spark, sf):
    return table(spark, sf, "supplier").where((F.col("s_acctbal") > 0) & F.col("s_nationkey").isin(1, 2, 3)).orderBy("s_name").select("s_suppkey", "s_name")


@query("p10_document_list", "SELECT doc_id FROM documents WHERE source = 'src3' AND contains(lower(regexp_extract(text, '^[^.!?\n]*')), 'the')")
def document_list(spark, sf):
    d = table(spark, sf, "documents").withColumn("title", heading(F.col("text")))
    return P.facets(d, equal={"source": "src3"}, text={"title": "The"}).select("doc_id")


@query("p16_retrieval_scope", PUBLICATIONS + "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT publication_id FROM publications WHERE source IN ('src1', 'src2') AND publication_year BETWEEN 1993 AND 1995)")
def retrieval_scope(spark, sf):
    scope = P.facets(publications(spark, sf), low={"publication_year": 1993}, high={"publication_year": 1995}).where(F.col("source").isin("src1", "src2"))
    return table(spark, sf, "lineitem").join(scope.select(F.col("publication_id").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("p17_embedding_candidates", PUBLICATIONS + "SELECT publication_id FROM publications WHERE NOT is_deleted AND title IS NOT NULL AND (abstract IS NULL OR doi IS DISTINCT FROM '10.1234/p.' || publication_id)")
def embedding_candidates(spark, sf):
    same = F.col("doi").eqNullSafe(F.concat(F.lit("10.1234/p."), F.col("publication_id").cast("string")))
    return publications(spark, sf).where(~F.col("is_deleted") & F.col("title").isNotNull() & (F.col("abstract").isNull() | ~same)).select("publication_id")


@query("p18_active", PUBLICATIONS + "SELECT publication_id FROM publications WHERE NOT is_deleted")
def active(spark, sf):
    return publications(spark, sf).where(~F.col("is_deleted")).select("publication_id")


@query("j2_keywords", "SELECT l_orderkey AS publication_id, p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7")
def keyword_join(spark, sf):
    k = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("keyword_id"), F.col("p_name").alias("term"))
    return keyword_links(spark, sf).join(k, "keyword_id").select("publication_id", "term")


@query("j3_report_join", PUBLICATIONS + "SELECT n_name, count(*) AS reports, round(avg(quality_score), 4) AS mean FROM publications JOIN nation ON repository_id = n_nationkey WHERE quality_score IS NOT NULL GROUP BY n_name")
def report_join(spark, sf):
    g = publications(spark, sf).where("quality_score is not null").groupBy("repository_id").agg(F.count("*").alias("reports"), F.avg("quality_score").alias("m"))
    return g.join(F.broadcast(table(spark, sf, "nation")), F.col("repository_id") == F.col("n_nationkey")).select("n_name", "reports", F.round("m", 4).alias("mean"))


@query("j6_nested_scope", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50))")
def nested_scope(spark, sf):
    inner = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    outer = table(spark, sf, "orders").join(inner, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(outer, "c_custkey", "left_semi").select("c_custkey")


@query("j10_containment", "SELECT a.item_id, d.doc_id FROM benchmark a JOIN documents d ON contains(lower(d.text), array_to_string(regexp_extract_all(lower(a.text), '[^\\x20\\x09-\\x0D]+')[1:8], ' ')) WHERE len(regexp_extract_all(a.text, '[^\\x20\\x09-\\x0D]+')) >= 8".replace("\\\\", "\\"))
def containment(spark, sf):
    """Documents that hold a benchmark text's first eight words: found by their runs of four, then compared as they are."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    heads = table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= 8)
    # Whole inner words are shared even where the first and the last are cut.
    heads = heads.select("item_id", F.array_join(F.slice("w", 1, 8), " ").alias("head"), F.array_join(F.slice("w", 2, 6), " ").alias("run"))
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    runs = d.select("doc_id", words(F.col("low")).alias("w")).where(F.size("w") >= 6).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " ")))).alias("run"))
    pairs = runs.join(heads, "run").select("item_id", "doc_id", "head").distinct()
    return pairs.join(d, "doc_id").where(F.contains("low", F.col("head"))).select("item_id", "doc_id")


@query("j13_document_resolution", PUBLICATIONS + """SELECT doc_id, publication_id, rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, publication_id) AS r FROM (
SELECT doc_id, publication_id, 1 AS rule FROM documents JOIN publications ON publication_id = doc_id WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, publication_id, 2 FROM documents JOIN publications ON doi = '10.1234/p.' || (doc_id * 3))) WHERE r = 1""")
def document_resolution(spark, sf):
    d, p = table(spark, sf, "documents").select("doc_id"), publications(spark, sf).select("publication_id", "doi")
    by_id = d.where("doc_id % 3 = 0").join(p, F.col("doc_id") == F.col("publication_id")).select("doc_id", "publication_id", F.lit(1).alias("rule"))
    by_doi = d.join(p, F.concat(F.lit("10.1234/p."), (F.col("doc_id") * 3).cast("string")) == F.col("doi")).select("doc_id", "publication_id", F.lit(2).alias("rule"))
    return W.best(by_id.unionByName(by_doi), ["doc_id"], F.struct("rule", "publication_id"), ["publication_id", "rule"])


@query("j14_link_repair", PUBLICATIONS + "SELECT doc_id, CASE count(publication_id) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'linked' ELSE 'ambiguous' END AS state FROM documents LEFT JOIN publications ON doi = '10.1234/p.' || doc_id GROUP BY doc_id")
def link_repair(spark, sf):
    n = publications(spark, sf).where("doi is not null").groupBy("doi").agg(F.count("*").alias("n"))
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("10.1234/p."), F.col("doc_id").cast("string")).alias("doi"))
    return d.join(n, "doi", "left").select("doc_id", F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "linked").otherwise("ambiguous").alias("state"))


@query("a5_source_activity", PUBLICATIONS + "SELECT source, max(publication_year) AS latest, count(DISTINCT author_id) AS authors FROM publications GROUP BY source")
def source_activity(spark, sf):
    return publications(spark, sf).groupBy("source").agg(F.max("publication_year").alias("latest"), F.count_distinct("author_id").alias("authors"))


@query("a10_chunk_summary", "SELECT l_orderkey, count(*) AS chunks, sum(length(l_returnflag || l_linestatus))::BIGINT AS characters, max(l_linenumber) AS last FROM lineitem GROUP BY 1")
def chunk_summary(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("chunks"), F.sum(F.length(F.concat("l_returnflag", "l_linestatus"))).alias("characters"), F.max("l_linenumber").alias("last"))


@query("a11_filtered_count", PUBLICATIONS + "SELECT count(*) AS n FROM publications WHERE language = 'en' AND publication_year >= 1995")
def filtered_count(spark, sf):
    return P.facets(publications(spark, sf), equal={"language": "en"}, low={"publication_year": 1995}).agg(F.count("*").alias("n"))


@query("a15_import_preview", "SELECT count(*) FILTER (WHERE doc_id % 31 <> 0) AS valid, count(*) FILTER (WHERE doc_id % 31 = 0) AS invalid, count(*) FILTER (WHERE doc_id % 17 = 0) AS deleted FROM documents")
def import_preview(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").agg(F.count_if(k % 31 != 0).alias("valid"), F.count_if(k % 31 == 0).alias("invalid"), F.count_if(k % 17 == 0).alias("deleted"))


@query("a17_download_summary", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1, 2")
def download_summary(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("a18_coverage", "SELECT lang, count(*) AS n, count(toxic) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("toxic").alias("labelled"))


@query("a20_citation_counters", "SELECT conv_id, count(DISTINCT role) AS roles, count(*) AS turns, CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN 0.75::DOUBLE ELSE 0::DOUBLE END AS confidence FROM conversations GROUP BY conv_id")
def citation_counters(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("roles"), F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("a"))
    return g.select("conv_id", "roles", "turns", F.when(F.col("a") > 0, 0.75).otherwise(0.0).alias("confidence"))


@query("a22_distinct_after_join", "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def distinct_after_join(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("w4_best_match", "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_extendedprice DESC, l_partkey) AS r FROM lineitem) WHERE r = 1")
def best_match(spark, sf):
    order = F.struct((F.col("l_linenumber") % 2).alias("p"), (-F.col("l_extendedprice")).alias("s"), F.col("l_partkey").alias("k"))
    return W.best(table(spark, sf, "lineitem"), ["l_orderkey"], order, ["l_partkey"])


@query("w7_chunk_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS chunk_index FROM lineitem")
def chunk_index(spark, sf):
    index = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("long") - 1
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", index.alias("chunk_index"))


@query("w8_top_two", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def top_two(spark, sf):
    return W.top(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("w11_latest_nulls_last", PUBLICATIONS + "SELECT author_id, publication_id FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY publication_year DESC NULLS LAST, publication_id) AS r FROM publications) WHERE r = 1")
def latest_nulls_last(spark, sf):
    return W.top(publications(spark, sf), ["author_id"], [F.desc_nulls_last("publication_year"), F.col("publication_id")]).select("author_id", "publication_id")


@query("t4_vector_minimum", "SELECT b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id = 0 AND b.vec_id <> 0 WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) >= 0.1 ORDER BY similarity DESC, b.vec_id LIMIT 20")
def vector_minimum(spark, sf):
    e = table(spark, sf, "embeddings")
    found = R.nearest(e.where("vec_id = 0"), e, 20, id_col="vec_id", vector_col="embedding", least=0.1)
    return found.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("t5_nulls_last", PUBLICATIONS + "SELECT publication_id FROM publications ORDER BY quality_score DESC NULLS LAST, updated_at DESC, publication_id LIMIT 50")
def nulls_last(spark, sf):
    return publications(spark, sf).orderBy(F.desc_nulls_last("quality_score"), F.desc("updated_at"), "publication_id").limit(50).select("publication_id")


@query("u2_shared_terms", "SELECT a.l_orderkey AS first_id, b.l_orderkey AS second_id, count(DISTINCT a.l_partkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey WHERE a.l_orderkey % 50 = 0 GROUP BY 1, 2 HAVING count(DISTINCT a.l_partkey) >= 2")
def shared_terms(spark, sf):
    """A search: every fiftieth publication against all."""
    k = keyword_links(spark, sf).distinct()
    a = k.where("publication_id % 50 = 0").withColumnRenamed("publication_id", "first_id")
    pairs = a.join(k.withColumnRenamed("publication_id", "second_id"), "keyword_id").where("first_id <> second_id")
    return pairs.groupBy("first_id", "second_id").agg(F.count("*").alias("shared")).where("shared >= 2")


@query("f18_keywords", "SELECT p_partkey, p_brand || '|' || p_type AS keywords FROM part")
def clean_keywords(spark, sf):
    raw = F.array("p_brand", F.concat(F.lit(" "), "p_type"), F.repeat(F.lit("x"), 300), F.upper("p_brand"), F.lit("  "))
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.keyword_list(raw), "|").alias("keywords"))


@query("f33_embedding_text", "SELECT o_orderkey, 'Title: On ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Abstract: A' ELSE '' END || chr(10) || 'Subjects: x; y' AS t FROM orders")
def embedding_text(spark, sf):
    text = S.embedding_text(F.concat(F.lit("On "), "o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, " A ").otherwise("  "), F.array(F.lit("x"), F.lit("y")))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("t"))


@query("f38_quick_score", "SELECT doc_id, (100 - 14 * (doc_id % 3 = 0)::INT - 5 * (doc_id % 4 = 0)::INT - 5 * (doc_id % 5 = 0)::INT)::INT AS score FROM documents")
def quick_score(spark, sf):
    k = F.col("doc_id")
    gap = lambda n: F.when(k % n != 0, "x")
    return table(spark, sf, "documents").select("doc_id", S.quick_score([gap(3), F.lit("y")], [gap(4), gap(5)]).alias("score"))


@query("f44_unique_code", "SELECT n_nationkey, left(n_name, 3) || CASE WHEN row_number() OVER (PARTITION BY left(n_name, 3) ORDER BY n_nationkey) = 1 THEN '' ELSE '-' || row_number() OVER (PARTITION BY left(n_name, 3) ORDER BY n_nationkey) END AS code FROM nation")
def unique_code(spark, sf):
    base = F.left("n_name", F.lit(3))
    n = F.row_number().over(Window.partitionBy(base).orderBy("n_nationkey"))
    return table(spark, sf, "nation").select("n_nationkey", F.concat(base, F.when(n == 1, "").otherwise(F.concat(F.lit("-"), n.cast("string")))).alias("code"))


@query("f46_metadata_hash", PUBLICATIONS + "SELECT publication_id, sha256(title || '|' || coalesce(publication_year::VARCHAR, '') || '|' || coalesce(doi, '')) AS h FROM publications")
def metadata_hash(spark, sf):
    e = F.lit("")
    return publications(spark, sf).select("publication_id", F.sha2(F.concat_ws("|", "title", F.coalesce(F.col("publication_year").cast("string"), e), F.coalesce("doi", e)), 256).alias("h"))


@query("d10_keyword_resolution", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_type)) AS keyword_id FROM part")
def keyword_resolution(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("k"))
    return p.join(p.groupBy("k").agg(F.min("p_partkey").alias("keyword_id")), "k").select("p_partkey", "keyword_id")


@query("d15_invalidation", PUBLICATIONS + "SELECT publication_id, CASE WHEN publication_id % 7 = 0 THEN NULL ELSE sha256(title) END AS content_hash FROM publications")
def invalidation(spark, sf):
    p, k = publications(spark, sf).select("publication_id", "title"), F.col("publication_id")
    new = p.withColumn("title", F.when(k % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    touched = W.changes(p, new, "publication_id", ["title"]).select("publication_id", F.lit(True).alias("t")).distinct()
    return p.join(touched, "publication_id", "left").select("publication_id", F.when(F.col("t").isNull(), F.sha2("title", 256)).alias("content_hash"))


@query("d18_unchanged_skip", "SELECT doc_id FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 <> 0)")
def unchanged_skip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    indexed = d.where("doc_id % 2 = 0").withColumn("checksum", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("checksum")))
    return d.join(indexed, ["doc_id", "checksum"], "left_anti").select("doc_id")


@query("k4_embedding_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings")
def embedding_upsert(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    both = e.select("vec_id", F.lit("old").alias("model"), F.lit(1).alias("at")).unionByName(e.where("vec_id % 3 = 0").select("vec_id", F.lit("new").alias("model"), F.lit(2).alias("at")))
    return W.best(both, ["vec_id"], -F.col("at"), ["model"])


@query("k5_chunk_replacement", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 AND l_linenumber <= 2 THEN 'new' ELSE 'old' END AS state FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_linenumber <= 2 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2)")
def chunk_replacement(spark, sf):
    old = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("state"))
    new = old.where("l_orderkey % 4 = 0 and l_linenumber <= 2").withColumn("state", F.lit("new"))
    return old.join(new.select("l_orderkey").distinct(), "l_orderkey", "left_anti").unionByName(new)


@query("q9_report_change", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'F'")
def report_change(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return W.changes(o, o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise(F.col("o_orderstatus"))), "o_orderkey", ["o_orderstatus"]).select("o_orderkey")


_LIKE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query("r3_similar_publications", f"SELECT query_id, id, rank::INT AS rank, similarity, shared FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_LIKE}, 6) AS similarity, a.label = b.label AS shared, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_LIKE} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND {_LIKE} >= 0) WHERE rank <= 10")
def similar_publications(spark, sf):
    """Ten nearest vectors of each fiftieth vector, and whether they share its label."""
    e = table(spark, sf, "embeddings")
    found = R.nearest(e.where("vec_id % 50 = 0"), e, 10, id_col="vec_id", vector_col="embedding", least=0.0)
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a"))
    return found.join(own, "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id").select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"), (F.col("a") == F.col("b")).alias("shared"))


_TERM_STOP = ", ".join(f"'{w}'" for w in R.TERM_STOP)


@query("r7_keyword_suggestions", f"""SELECT doc_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS r FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{R.SUGGESTED}'), lambda w: w NOT IN ({_TERM_STOP}))) AS term FROM documents) GROUP BY doc_id, term) WHERE r <= 8""")
def keyword_suggestions(spark, sf):
    counted = S.counted(table(spark, sf, "documents").select("doc_id", S.word_list(F.col("text"), R.SUGGESTED, R.TERM_STOP).alias("w")), "w")
    return S.each_count(counted, ["doc_id"], S.most_common(F.col("_counts"), 8, by_term=True)).select("doc_id", "c.term")


@query("r9b_summary_source", "SELECT doc_id, CASE WHEN coalesce(trim(text), '') <> '' AND item THEN 'full text' WHEN doc_id % 7 <> 0 AND coalesce(trim(text), '') <> '' THEN 'abstract' ELSE 'metadata' END AS kind FROM (SELECT doc_id, text, doc_id IN (SELECT doc_id FROM labels) AS item FROM documents)")
def summary_source(spark, sf):
    """The indexed full text, else the abstract, else the metadata: labelled documents are indexed, every seventh lacks its abstract."""
    d, blank = table(spark, sf, "documents"), F.coalesce(F.trim("text"), F.lit("")) == ""
    indexed = table(spark, sf, "labels").select("doc_id").distinct().withColumn("indexed", F.lit(True))
    return d.join(indexed, "doc_id", "left").select("doc_id", F.when(~blank & F.col("indexed").isNotNull(), "full text").when(~blank & (F.col("doc_id") % 7 != 0), "abstract").otherwise("metadata").alias("kind"))


@query("r2_embeddings", f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{R.TERM}'), lambda w: w NOT IN ({_TERM_STOP})) AS w FROM documents),
p AS (SELECT doc_id, CAST(concat('0x', substr(md5(term), 1, 8)) AS BIGINT) % 64 AS place, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM p GROUP BY doc_id)
SELECT doc_id, i::INT AS place, CASE WHEN norm IS NOT NULL THEN round((coalesce(n, 0) / norm)::FLOAT::DOUBLE, 5) END AS component FROM w CROSS JOIN (SELECT unnest(range(64)) AS i) LEFT JOIN p ON p.doc_id = w.doc_id AND place = i LEFT JOIN l ON l.doc_id = w.doc_id""".replace("SELECT doc_id, i::INT", "SELECT w.doc_id, i::INT"))
def embeddings(spark, sf):
    """Every component of every document's vector; a document without terms has none."""
    e = R.encoded(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return e.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place"), "embedding").select("doc_id", "place", F.round(F.get("embedding", F.col("place")).cast("double"), 5).alias("component"))


@query("r16_citation_records", r"SELECT page_id, left(trim(regexp_replace(html, '\s+', ' ', 'g')), 1200) AS excerpt, CASE WHEN regexp_matches(url, '(?i)^https?://[^/\s?#]+') THEN url END AS url FROM pages")
def citation_records(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.left(S.clean(F.col("html")), F.lit(1200)).alias("excerpt"), P.public_url(F.col("url")).alias("url"))


@query("j9_connector_publications", PUBLICATIONS + ", c AS (SELECT 'src' || s_suppkey AS code FROM supplier) SELECT code, publication_year::VARCHAR AS publication_year, count(*) AS n FROM c JOIN publications ON source = code GROUP BY 1, 2")
def connector_publications(spark, sf):
    g = publications(spark, sf).groupBy(F.col("source").alias("code"), "publication_year").agg(F.count("*").alias("n"))
    return g.join(connectors(spark, sf).select("code"), "code", "left_semi").select("code", F.col("publication_year").cast("string").alias("publication_year"), "n")


@query("d2_engine_key", PUBLICATIONS + "SELECT key, count(*) AS n FROM (SELECT coalesce('doi:' || doi, 'title:' || regexp_replace(lower(title), '[^a-z0-9_ ]', '', 'g') || coalesce(':' || publication_year, '')) AS key FROM publications) GROUP BY key")
def engine_key(spark, sf):
    none = F.lit(None).cast("string")
    key = D.strongest_key(F.col("doi"), F.col("source"), none, F.col("title"), F.col("publication_year"))
    return publications(spark, sf).groupBy(key.alias("key")).agg(F.count("*").alias("n"))
