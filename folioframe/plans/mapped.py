"""Values of mixed kinds, which Spark derives from the given tables: import rows, repository items, manifests, JSON arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..operators.quality import WEIGHTS
from ..sources import mappings as M
from .registry import query
from .views import table

_STRIP = r"nullif(regexp_replace({0}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g'), '')"


def _member(c, name):
    """"name": value as JSON text; null if the value is."""
    return F.nullif(F.regexp_extract(F.to_json(F.struct(c.alias(name))), r"(?s)^\{(.*)\}$", 1), F.lit(""))


def _object(*members):
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _rows(spark, sf):
    """An import row a document; title, authors, year and id come in turn as text, lists, objects, and under metadata."""
    d, k, n = table(spark, sf, "documents"), F.col("doc_id"), F.col("doc_id").cast("string")
    title = F.when(k % 11 == 0, F.lit('"title":[null,{"name":""}]')).when(k % 4 == 0, F.concat(F.lit('"title":" T '), n, F.lit('"'))).when(k % 4 == 2, F.concat(F.lit('"title":[null,0,{"text":"T '), n, F.lit('"}]'))).when(k % 4 == 3, F.concat(F.lit('"name":{"value":"","name":"T '), n, F.lit('"}')))
    inner = F.concat_ws(
        ",", F.when((k % 4 == 1) & (k % 11 != 0), F.concat(F.lit('"dc.title":[{"value":"T '), n, F.lit('"}]'))), F.when(k % 3 == 2, _member(F.struct(F.col("lang").alias("value")), "dc.contributor.author")),
        F.when(k % 5 == 1, F.lit('"dc.date.issued":["2019-05-01"]')),
    )
    people = F.when(k % 3 == 0, F.lit('"authors":"Ada; Bo, Cy"')).when(k % 3 == 1, F.lit('"authors":["Ada",{"name":"Bo"},{"value":"","text":"Di"},0,false]'))
    year = F.when(k % 5 == 0, F.concat(F.lit('"year":'), (2000 + k % 20).cast("string"))).when(k % 5 == 2, F.lit('"year":"n.d."'))
    raw = _object(title, people, year, _member(F.col("text"), "abstract"), F.when(k % 2 == 1, F.concat(F.lit('"external_id":"e'), n, F.lit('"'))).otherwise(F.concat(F.lit('"handle":"h/'), n, F.lit('"'))), F.when(k % 7 == 0, F.lit('"is_deleted":true')), F.concat(F.lit('"metadata":{'), inner, F.lit("}")))
    return d.select("doc_id", F.when(k % 23 == 0, "7").otherwise(raw).alias("raw"))


@query("n2_mixed_values", f"""SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'the record is not an object' WHEN doc_id % 11 = 0 THEN 'A record is missing its title' END AS error, CASE WHEN doc_id % 23 <> 0 AND doc_id % 11 <> 0 THEN 'T ' || doc_id END AS title,
CASE WHEN doc_id % 23 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'Ada|Bo|Cy' WHEN doc_id % 3 = 1 THEN 'Ada|Bo|Di' ELSE coalesce({_STRIP.format("lang")}, '') END AS authors,
CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 2000 + doc_id % 20 WHEN doc_id % 5 = 1 THEN 2019 END::INT AS publication_year,
CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 2 = 1 THEN 'e' || doc_id ELSE 'h/' || doc_id END AS external_id, doc_id % 7 = 0 AND doc_id % 23 <> 0 AS is_deleted, CASE WHEN doc_id % 23 <> 0 THEN sha256({_STRIP.format("text")}) END AS abstract FROM documents""")
def mixed_values(spark, sf):
    p = M.publications(_rows(spark, sf))
    return p.select("doc_id", "error", "title", F.array_join("authors", "|").alias("authors"), "publication_year", "external_id", "is_deleted", F.sha2("abstract", 256).alias("abstract"))


def _items(spark, sf):
    """A repository item a document: its handle bare, as an address, under an identifier, or missing."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    own = F.when(k % 4 == 0, F.concat(F.lit('"handle":" 123/'), n, F.lit('"'))).when(k % 4 == 1, F.concat(F.lit('"handle":"https://r.org/xmlui/handle/123/'), n, F.lit('/?a=1"')))
    uri = F.when(k % 4 == 2, F.concat(F.lit('"dc.identifier.uri":[{"value":"isbn"},{"value":"http://hdl.handle.net/123/'), n, F.lit('"},"x"]')))
    meta = F.concat_ws(",", uri, _member(F.array(F.struct(F.col("source").alias("value")), F.struct(F.lit(" Bo ").alias("value"))), "dc.contributor.author"), F.when(k % 5 != 0, F.lit('"dc.title":[{"value":"Item"}]')))
    item = _object(F.when(k % 13 != 0, F.concat(F.when(k % 2 == 0, F.lit('"uuid":"u')).otherwise(F.lit('"id":"u')), n, F.lit('"'))), own, F.lit('"name":" named "'), F.concat(F.lit('"metadata":{'), meta, F.lit("}")))
    return table(spark, sf, "documents").select("doc_id", item.alias("item"))


@query("s9_landing_records", f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'w:u' || doc_id ELSE 'w:123/' || doc_id END AS external_id, CASE WHEN doc_id % 5 = 0 THEN 'named' ELSE 'Item' END AS title,
CASE WHEN doc_id % 4 = 3 THEN 'https://r.org/items/u' || doc_id ELSE 'https://r.org/handle/123/' || doc_id END AS landing_url, CASE WHEN doc_id % 4 = 2 THEN 3 ELSE 1 END::INT AS identifiers, concat_ws('|', {_STRIP.format("source")}, CASE WHEN {_STRIP.format("source")} IS DISTINCT FROM 'Bo' THEN 'Bo' END) AS authors FROM documents WHERE doc_id % 13 <> 0""")
def landing_records(spark, sf):
    r = M.landing_records(_items(spark, sf), F.lit("https://r.org/"), "w")
    return r.select("doc_id", "external_id", "title", "landing_url", F.size("identifiers").alias("identifiers"), F.array_join("authors", "|").alias("authors"))


@query("s9_landing_by_uuid", """SELECT doc_id, 'u' || doc_id AS external_id, CASE doc_id % 4 WHEN 0 THEN 'https://r.org/handle/123/' || doc_id WHEN 1 THEN 'https://r.org/handle/https://r.org/xmlui/handle/123/' || doc_id || '/?a=1' WHEN 2 THEN 'isbn' ELSE 'https://r.org/items/u' || doc_id END AS landing_url FROM documents WHERE doc_id % 13 <> 0""")
def landing_by_uuid(spark, sf):
    """As the second kind of repository gives them: its handle is taken as it stands."""
    return M.landing_records(_items(spark, sf), F.lit("https://r.org")).select("doc_id", "external_id", "landing_url")


@query("s11_landing_urls", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://r.org/view/' || page_id || '/' WHEN 1 THEN 'https://r.org/items/x' WHEN 2 THEN url END AS landing_url FROM pages WHERE page_id % 4 <> 2 OR regexp_matches(url, '^https?://') AND NOT contains(url, 'handle') AND NOT contains(url, '/items/')")
def landing_urls(spark, sf):
    """A record's page among its links: by its own number, by the shape of the address, else the first."""
    k, n, u = F.col("page_id"), F.col("page_id").cast("string"), F.col("url")
    mine, shaped = F.concat(F.lit("https://r.org/view/"), n, F.lit("/")), F.lit("https://r.org/items/x")
    links = F.when(k % 4 == 0, F.array(F.lit("doi"), shaped, mine)).when(k % 4 == 1, F.array(F.lit("https://r.org/q"), shaped)).when(k % 4 == 2, F.array(F.lit("ftp://x"), u, F.lit("http://later"))).otherwise(F.array(F.lit("isbn")))
    p = table(spark, sf, "pages").where((k % 4 != 2) | (u.rlike("^https?://") & ~F.contains(u, F.lit("handle")) & ~F.contains(u, F.lit("/items/"))))
    return p.select("page_id", M.landing_url(F.concat(F.lit("oai:r.org:"), n), links).alias("landing_url"))


@query("s16_manifest_layouts", """WITH e AS (SELECT page_id // 100 AS manifest, page_id, row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS position, 'f' || (page_id % 60) || '.pdf' AS base FROM pages)
SELECT manifest, base, max(page_id) AS page_id FROM e WHERE page_id % 10 <> 9 AND manifest % 5 <> 4 GROUP BY manifest, base""")
def manifest_layouts(spark, sf):
    """A hundred pages a manifest: a list, documents, items and an object by name in turn, each fifth one broken; names repeat, and some entries are no objects or have no path."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    path = F.concat(F.when(k % 3 == 0, F.lit('"local_path":"/data/')).when(k % 3 == 1, F.lit('"local_path":"","path":"x/y/')).otherwise(F.lit('"final_path":"')), F.lit("f"), (k % 60).cast("string"), F.lit('.pdf"'))
    entry = F.when(k % 20 == 9, "7").when(k % 20 == 19, F.concat(F.lit('{"page_id":'), n, F.lit("}"))).otherwise(_object(path, F.concat(F.lit('"page_id":'), n)))
    listed = lambda member: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))), member), ",")
    m = F.floor(k / 100).cast("long")
    files = table(spark, sf, "pages").groupBy(m.alias("manifest")).agg(listed(lambda x: x["e"]).alias("l"), listed(lambda x: F.concat(F.lit('"'), (-x["k"]).cast("string"), F.lit('":'), x["e"])).alias("o"))
    kind, l, o = F.col("manifest") % 5, F.col("l"), F.col("o")
    text = F.when(kind == 0, F.concat(F.lit("["), l, F.lit("]"))).when(kind == 1, F.concat(F.lit('{"documents":['), l, F.lit("]}"))).when(kind == 2, F.concat(F.lit('{"documents":[],"items":{'), o, F.lit("}}"))).when(kind == 3, F.concat(F.lit("{"), o, F.lit("}"))).otherwise(F.concat(F.lit("["), l))
    return M.manifest_entries(files.select("manifest", text.alias("content"))).select("manifest", "base", F.try_variant_get("entry", "$.page_id", "bigint").alias("page_id"))


@query("s14_json_arrays", "SELECT file, CASE WHEN file % 7 <> 6 THEN records END AS records, CASE WHEN file % 7 <> 6 THEN skipped END AS skipped, file % 7 = 6 AS failed FROM (SELECT doc_id // 20 AS file, count(*) FILTER (WHERE doc_id % 10 <> 3)::INT AS records, count(*) FILTER (WHERE doc_id % 10 = 3)::INT AS skipped FROM documents GROUP BY 1)")
def json_arrays(spark, sf):
    """Twenty documents a file; every tenth entry is no object, every seventh file no array."""
    k = F.col("doc_id")
    entry = F.when(k % 10 == 3, F.to_json(F.array("text"))).otherwise(F.to_json(F.struct("doc_id", "text")))
    files = table(spark, sf, "documents").groupBy(F.floor(k / 20).cast("long").alias("file")).agg(F.array_join(F.collect_list(entry), ",").alias("l"))
    content = F.when(F.col("file") % 7 == 6, F.concat(F.lit('{"records":['), "l", F.lit("]}"))).otherwise(F.concat(F.lit("["), "l", F.lit("]")))
    return M.array_entries(files.select("file", content.alias("content"))).select("file", "records", "skipped", F.col("error").isNotNull().alias("failed"))


@query("f22_alias_values", f"SELECT page_id, CASE page_id % 6 WHEN 0 THEN {_STRIP.format('url')} WHEN 1 THEN 'a|b' WHEN 2 THEN 'inner' WHEN 3 THEN 'second' WHEN 4 THEN '12|True' ELSE '' END AS found FROM pages")
def alias_values(spark, sf):
    """Under one of two names or in the metadata: an address, a list of objects, numbers and truth values, nothing."""
    k = F.col("page_id") % 6
    raw = (
        F.when(k == 0, _object(_member(F.col("url"), "a"), F.lit('"b":"no"'))).when(k == 1, F.lit('{"a":[{"value":" a "},{"value":null,"text":"b"},{"q":1},null]}')).when(k == 2, F.lit('{"a":"","b":"late","metadata":{"a":{"name":"inner"}}}'))
        .when(k == 3, F.lit('{"a":[0,false," "],"metadata":{"a":"unseen"},"b":"second"}')).when(k == 4, F.lit('{"b":[12,true,0]}')).otherwise(F.lit('{"a":null,"b":[],"metadata":[]}'))
    )
    p = table(spark, sf, "pages").select("page_id", F.try_parse_json(raw).alias("v"))
    return p.select("page_id", F.array_join(M.alias_values(F.col("v"), M.at(F.col("v"), "metadata"), "a", "b"), "|").alias("found"))


@query("f47_json_safe", """SELECT event_id, '{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || '","day":"' || strftime(ts, '%Y-%m-%d') || '","amounts":[{"key":' || user_id || ',"value":"' || CAST(event_id % 1000 AS DECIMAL(12,2)) || '"}],"by_day":{"' || strftime(ts, '%Y-%m-%d') || '":["' || event_type || '"]}}' AS safe FROM events""")
def json_safe(spark, sf):
    """Times, days, decimals, and maps by day, nested in each other."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    amount = F.struct(F.col("user_id").alias("key"), (F.col("event_id") % 1000).cast("decimal(12,2)").alias("value"))
    e = e.select("event_id", F.struct(F.col("ts").alias("at"), F.to_date("ts").alias("day"), F.array(amount).alias("amounts"), F.create_map(F.to_date("ts"), F.array("event_type")).alias("by_day")).alias("v"))
    return e.select("event_id", F.to_json(X.json_safe(F.col("v"), e.schema["v"].dataType)).alias("safe"))


_GIVEN = "CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 1000 ELSE -1 END"
_RAW = {k: f"greatest({_GIVEN}, 0)" if k == "completeness" else f"CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE {v} END" for k, v in WEIGHTS.items()}


@query("f42_weights", f"SELECT s_suppkey, {', '.join(f'round(CASE WHEN s_suppkey % 5 = 0 THEN {v} ELSE ({_RAW[k]}) / ({' + '.join(f'({x})' for x in _RAW.values())}) END, 9) AS {k}' for k, v in WEIGHTS.items())} FROM supplier")
def weights(spark, sf):
    """A supplier's balance weighs completeness, negative ones none; every fifth gives nothing but negatives and gets the defaults."""
    k = F.col("s_suppkey")
    given = {"completeness": F.when(k % 5 != 0, F.col("s_acctbal") / 1000).otherwise(-1.0)} | {n: F.when(k % 5 == 0, -1.0) for n in WEIGHTS if n != "completeness"}
    return table(spark, sf, "supplier").select("s_suppkey", *[F.round(c, 9).alias(n) for n, c in X.shares(given, WEIGHTS).items()])
