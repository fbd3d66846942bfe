"""Scans and streams over pages that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import records as R
from ..sources.folders import folder
from ..streaming import ingest
from .registry import query
from .views import heading, table


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _oai_pages(spark, sf):
    """Ten documents a page, as a repository lists them."""
    k = F.col("doc_id")
    head = F.concat(F.lit('<header status="'), F.when(k % 17 == 0, "deleted").otherwise("ok"), F.lit('"><identifier>oai:x:'), k.cast("string"), F.lit("</identifier><datestamp>2024-01-01T00:00:00Z</datestamp><setSpec>"), F.col("source"), F.lit("</setSpec></header>"))
    body = F.concat(F.lit("<metadata><oai_dc:dc><dc:title>"), _escaped(heading(F.col("text"))), F.lit("</dc:title><dc:creator>A "), (k % 9).cast("string"), F.lit("</dc:creator><dc:creator>B</dc:creator><dc:language>"), F.col("lang"), F.lit("</dc:language></oai_dc:dc></metadata>"))
    record = F.concat(F.lit("<record>"), head, F.when(k % 17 == 0, "").otherwise(body), F.lit("</record>"))
    page = table(spark, sf, "documents").groupBy("source", F.floor(k / 200).alias("page_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("r")))), lambda x: x["r"]), "").alias("rs"), F.count("*").alias("n"))
    token = F.concat(F.lit('<resumptionToken completeListSize="1" cursor="'), (F.col("page_no") * 10).cast("string"), F.lit('">T'), F.col("page_no").cast("string"), F.lit("</resumptionToken>"))
    return page.select("source", "page_no", F.concat(F.lit('<?xml version="1.0"?><OAI-PMH><ListRecords>'), "rs", token, F.lit("</ListRecords></OAI-PMH>")).alias("xml"))


@query("s1_oai_records", r"SELECT 'oai:x:' || doc_id AS identifier, doc_id % 17 = 0 AS deleted, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 3 + (trim(regexp_replace(regexp_extract(text, '^[^.!?\n]*'), '\s+', ' ', 'g')) <> '')::INT END::INT AS fields FROM documents")
def oai_records(spark, sf):
    return R.oai_records(_oai_pages(spark, sf)).select("identifier", "deleted", F.size("fields").alias("fields"))


@query("s5_completeness", "SELECT source, count(DISTINCT doc_id // 200) AS pages, count(*)::BIGINT AS records, 1::BIGINT AS promised, 0::BIGINT AS repeated_tokens, true AS complete FROM documents GROUP BY source")
def completeness(spark, sf):
    return R.completeness(R.oai_page_state(_oai_pages(spark, sf)))


@query("s6_dspace_items", "SELECT doc_id::VARCHAR AS identifier, doc_id % 13 = 0 OR doc_id % 11 = 0 AS deleted FROM documents WHERE doc_id % 7 <> 0")
def dspace_items(spark, sf):
    return R.dspace_items(_hal_pages(spark, sf)).select("identifier", "deleted")


def _hal_pages(spark, sf):
    k = F.col("doc_id")
    metadata = F.to_json(F.struct(F.array(F.struct(heading(F.col("text")).alias("value"))).alias("dc.title"), F.array(F.lit("X"), F.lit("Y")).alias("dc.contributor.author"), F.concat("lang", F.lit("_ET")).alias("dc.language.iso")))
    item = F.struct(k.cast("string").alias("uuid"), F.when(k % 7 == 0, "collection").otherwise("item").alias("type"), (k % 11 != 0).alias("inArchive"), (k % 13 == 0).alias("withdrawn"), metadata.alias("metadata"))
    wrapped = F.struct(F.struct(item.alias("indexableObject")).alias("_embedded"))
    page = table(spark, sf, "documents").groupBy(F.floor(k / 100).alias("page_no"), "source").agg(F.collect_list(wrapped).alias("objects"))
    return page.select("page_no", "source", F.to_json(F.struct(F.struct(F.struct(F.struct("objects").alias("_embedded")).alias("searchResult")).alias("_embedded"))).alias("json"))


@query("s7_dspace_fields", r"SELECT doc_id::VARCHAR AS identifier, 'language' AS key, lang AS value FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id::VARCHAR, 'creator', unnest(['X', 'Y']) FROM documents WHERE doc_id % 7 <> 0")
def dspace_fields(spark, sf):
    return R.dspace_fields(R.dspace_items(_hal_pages(spark, sf))).where("key <> 'title'").select("identifier", "key", "value")


@query("s12_json_import", "SELECT doc_id // 50 AS file, count(*) AS records, count(*) FILTER (WHERE doc_id % 10 = 0) AS errors FROM documents GROUP BY 1")
def json_import(spark, sf):
    k = F.col("doc_id")
    row = F.when(k % 10 == 0, F.lit("3")).otherwise(F.to_json(F.struct("doc_id", heading(F.col("text")).alias("title"))))
    listed = F.array_join(F.collect_list(row), ",")
    files = table(spark, sf, "documents").groupBy(F.floor(k / 50).alias("file")).agg(listed.alias("l"))
    content = F.when(F.col("file") % 3 == 0, F.concat(F.lit("["), "l", F.lit("]"))).when(F.col("file") % 3 == 1, F.concat(F.lit('{"records":['), "l", F.lit("]}"))).otherwise(F.concat(F.lit('{"items":['), "l", F.lit("]}")))
    return R.import_rows(files.select("file", content.alias("content"))).groupBy("file").agg(F.count("*").alias("records"), F.count("error").alias("errors"))


@query("s13_csv_import", "SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS name FROM customer")
def csv_import(spark, sf):
    """Written and read again, with quotes in the fields."""
    path = folder(spark, "csv")
    c = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name"))
    c.write.csv(path, header=True, escape='"', quoteAll=True)
    return R.csv_rows(spark, path, "c_custkey bigint, name string").select("c_custkey", "name")


@query("s16_manifest", "SELECT base, max(page_id) AS page_id FROM (SELECT regexp_extract(url, '([^/]*)$', 1) AS base, page_id FROM pages) GROUP BY base")
def manifest(spark, sf):
    return R.manifest(table(spark, sf, "pages").select(F.col("url").alias("path"), "page_id"), order="page_id").select("base", "page_id")


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return ingest.landed(spark, f"{sf}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("st5_event_counts", "SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts(spark, sf):
    out = folder(spark, "counts")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(out)
    ingest.drain(ingest.event_counts(_events(spark, sf), "ts", "event_type"), folder(spark, "mark"), write, "complete")
    return spark.read.parquet(out).select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n")


@query("st2_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    out, keys = folder(spark, "first"), ["user_id", "event_type"]
    ingest.drain(_events(spark, sf).select(*keys), folder(spark, "mark"), ingest.first_seen(out, keys))
    return spark.read.parquet(out).select(*keys)


@query("st3_stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events WHERE (user_id, ts) IN (SELECT user_id, max(ts) FROM events GROUP BY user_id) GROUP BY user_id")
def stream_upsert(spark, sf):
    out = folder(spark, "state")
    stream = _events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    ingest.drain(stream, folder(spark, "mark"), ingest.upsert_sink(out, "user_id", "ts"))
    return ingest.current_state(spark, out, stream.schema).select("user_id", "event_id")
