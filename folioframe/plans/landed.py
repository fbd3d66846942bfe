"""Landed answers of repositories, which Spark derives from the given tables: chains of pages, descriptions, downloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains
from ..sources import records as R
from .registry import query
from .views import heading, table

_FAULTY = "CASE WHEN source IS NULL THEN 0 ELSE CAST(regexp_extract(source, '[0-9]+') AS INT) % 5 END"


def _chained_pages(spark, sf):
    """A hundred ids a page. By the source's number: 1 gives an old token on page 3, 2 lacks page 4, 3 ends with a token that ran out, 4 promises more than it gives."""
    d = table(spark, sf, "documents").where("source is not null")
    kind = F.regexp_extract("source", "[0-9]+", 0).try_cast("int") % 5
    p = d.groupBy("source", F.floor(F.col("doc_id") / 100).cast("long").alias("page")).agg(F.count("*").alias("n")).withColumn("kind", F.coalesce(kind, F.lit(0))).where("not (kind = 2 and page = 4)")
    of = p.groupBy("source").agg(F.max("page").alias("last"), F.sum("n").alias("all"))
    p = p.join(of, "source")
    token = F.when((F.col("kind") == 1) & (F.col("page") == 3), "T2").when((F.col("page") == F.col("last")) & (F.col("kind") != 3), "").otherwise(F.concat(F.lit("T"), (F.col("page") + 1).cast("string")))
    until = F.when((F.col("kind") == 3) & (F.col("page") == F.col("last")), "2024-01-01T00:00:00Z").otherwise("2030-01-01T00:00:00Z")
    size = F.col("all") + F.when(F.col("kind") == 4, 1).otherwise(0)
    xml = F.concat(
        F.lit("<OAI-PMH><ListRecords>"), F.repeat(F.lit("<record></record>"), F.col("n").cast("int")), F.lit('<resumptionToken completeListSize="'), size.cast("string"), F.lit('" cursor="'), (F.col("page") * 100).cast("string"),
        F.lit('" expirationDate="'), until, F.lit('">'), token, F.lit("</resumptionToken></ListRecords></OAI-PMH>"),
    )
    return p.select("source", "page", F.when(F.col("page") > 0, F.concat(F.lit("T"), F.col("page").cast("string"))).alias("asked"), xml.alias("xml"))


@query("s5_page_chains", f"""WITH RECURSIVE c AS (SELECT * FROM (SELECT source, doc_id // 100 AS page, {_FAULTY} AS kind, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2, 3) WHERE NOT (kind = 2 AND page = 4)),
l AS (SELECT source, max(page) AS last, sum(n)::BIGINT AS total FROM c GROUP BY source),
p AS (SELECT c.*, last, total + CASE WHEN kind = 4 THEN 1 ELSE 0 END AS promised, CASE WHEN page > 0 THEN page END AS asked, CASE WHEN kind = 1 AND page = 3 THEN 2 WHEN page = last AND kind <> 3 THEN NULL ELSE page + 1 END AS token FROM c JOIN l USING (source)),
f AS (SELECT source, page, token, n, [page] AS seen FROM p WHERE asked IS NULL
  UNION ALL SELECT p.source, p.page, p.token, p.n, list_append(seen, p.page) FROM f JOIN p ON p.source = f.source AND p.asked = f.token AND NOT list_contains(seen, p.page)),
e AS (SELECT source, count(*) AS followed, sum(n)::BIGINT AS records, max(len(seen)) AS long, arg_max(token, len(seen)) AS token, arg_max(seen, len(seen)) AS seen, bool_or(token IS NULL) AS ended FROM f GROUP BY source)
SELECT source, pages, coalesce(followed, 0) AS followed, coalesce(records, 0)::BIGINT AS records, promised, CASE WHEN followed IS NULL THEN 'none' WHEN ended THEN CASE WHEN records >= promised THEN 'complete' ELSE 'short' END WHEN list_contains(seen, token) THEN 'repeated' WHEN kind = 3 THEN 'expired' ELSE 'gap' END AS ended
FROM (SELECT source, count(*) AS pages, max(promised)::BIGINT AS promised, any_value(kind) AS kind FROM p GROUP BY source) LEFT JOIN e USING (source)""")
def page_chains(spark, sf):
    """How far each source's pages follow from the first, and how the chain ends."""
    states = R.oai_page_state(_chained_pages(spark, sf))
    return chains.chain_report(states.select("source", "page", "asked", "token", "expires", "records", "complete_size"), "2024-07-16 00:00:00")


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _identify(spark, sf):
    """What a repository a supplier says of itself: some lack a granularity, some have two addresses."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    two = F.when(k % 3 == 0, F.concat(F.lit("<adminEmail>b"), k.cast("string"), F.lit("@x.org</adminEmail>"))).otherwise("")
    grain = F.when(k % 4 == 0, "").otherwise("<granularity>YYYY-MM-DD</granularity>")
    return s.select(k.alias("repository_id"), F.concat(F.lit("<OAI-PMH><Identify><repositoryName>"), _escaped(F.concat("s_name", F.lit(" & Co <x>"))), F.lit("</repositoryName><baseURL>https://r"), k.cast("string"), F.lit(".org/oai</baseURL><protocolVersion>2.0</protocolVersion><adminEmail>a"), k.cast("string"), F.lit("@x.org</adminEmail>"), two, F.lit("<earliestDatestamp>2001-01-01</earliestDatestamp><deletedRecord>transient</deletedRecord>"), grain, F.lit("</Identify></OAI-PMH>")).alias("xml"))


@query("s3_repositories", "SELECT s_suppkey AS repository_id, s_name || ' & Co <x>' AS name, 'https://r' || s_suppkey || '.org/oai' AS base_url, CASE WHEN s_suppkey % 4 <> 0 THEN 'YYYY-MM-DD' END AS granularity, CASE WHEN s_suppkey % 3 = 0 THEN 'a' || s_suppkey || '@x.org b' || s_suppkey || '@x.org' ELSE 'a' || s_suppkey || '@x.org' END AS admins FROM supplier")
def repositories(spark, sf):
    d = R.repository_descriptions(_identify(spark, sf))
    return d.select("repository_id", "name", "base_url", "granularity", F.array_join("admin_emails", " ").alias("admins"))


@query("s3_sets", "SELECT p_brand AS repository, p_type AS spec, 'All of ' || p_type AS name, count(*) AS answers FROM part GROUP BY ALL")
def sets(spark, sf):
    """One ListSets answer a part: its type is the set, its brand the repository."""
    xml = F.concat(F.lit("<OAI-PMH><ListSets><set><setSpec>"), _escaped(F.col("p_type")), F.lit("</setSpec><setName>All of "), _escaped(F.col("p_type")), F.lit("</setName></set><set><setName>no spec</setName></set></ListSets></OAI-PMH>"))
    return R.set_descriptions(table(spark, sf, "part").select(F.col("p_brand").alias("repository"), xml.alias("xml"))).groupBy("repository", "spec", "name").agg(F.count("*").alias("answers"))


@query("s3_formats", "SELECT c_mktsegment AS repository, prefix, count(*) AS answers FROM (SELECT c_mktsegment, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['oai_dc', 'mods'] ELSE ['oai_dc'] END) AS prefix FROM customer) GROUP BY ALL")
def formats(spark, sf):
    one = lambda p: f"<metadataFormat><metadataPrefix>{p}</metadataPrefix><schema>http://x/{p}.xsd</schema><metadataNamespace>http://x/{p}</metadataNamespace></metadataFormat>"
    xml = F.concat(F.lit("<OAI-PMH><ListMetadataFormats>" + one("oai_dc")), F.when(F.col("c_custkey") % 2 == 0, one("mods")).otherwise("<metadataFormat/>"), F.lit("</ListMetadataFormats></OAI-PMH>"))
    return R.metadata_formats(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("repository"), xml.alias("xml"))).groupBy("repository", "prefix").agg(F.count("*").alias("answers"))


@query("s11_downloads", r"""SELECT 'oai:x:' || doc_id AS identifier, trim(regexp_replace(regexp_extract(text, '^[^.!?\n]*'), '\s+', ' ', 'g')) AS title, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS links FROM documents
WHERE doc_id % 17 <> 0 AND trim(regexp_replace(regexp_extract(text, '^[^.!?\n]*'), '\s+', ' ', 'g')) <> ''""")
def downloads(spark, sf):
    """Records with a title as list pages give them; every seventeenth is deleted, every third has a second address, some an identifier that is none."""
    k = F.col("doc_id")
    url = F.concat(F.lit("<dc:identifier>https://r.org/"), k.cast("string"), F.lit("</dc:identifier><dc:identifier>isbn 1</dc:identifier><dc:relation>https://r.org/"), k.cast("string"), F.when(k % 3 == 0, ".pdf").otherwise(""), F.lit("</dc:relation>"))
    title = heading(F.col("text"))
    body = F.when((k % 17 == 0) | (F.trim(F.regexp_replace(title, r"\s+", " ")) == ""), "").otherwise(F.concat(F.lit("<metadata><dc:title>"), _escaped(title), F.lit("</dc:title>"), url, F.lit("</metadata>")))
    xml = F.concat(F.lit('<OAI-PMH><ListRecords><record><header status="'), F.when(k % 17 == 0, "deleted").otherwise(""), F.lit('"><identifier>oai:x:'), k.cast("string"), F.lit("</identifier></header>"), body, F.lit("</record></ListRecords></OAI-PMH>"))
    return R.downloads(table(spark, sf, "documents").where("text is not null").select(xml.alias("xml"))).select("identifier", "title", F.size("links").alias("links"))
