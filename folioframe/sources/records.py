"""Scans of landed pages and files into record tables, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Entities of XML.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
#: Codes of requests that can't succeed when repeated.
PERMANENT = ("badArgument", "badVerb", "cannotDisseminateFormat", "idDoesNotExist", "noMetadataFormats", "noSetHierarchy")
#: Names that one field goes by.
ALIASES = {"contributor.author": "creator", "date.issued": "date", "identifier.uri": "identifier", "description.abstract": "description", "language.iso": "language", "publisher.name": "publisher"}


def unescaped(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def element(xml: Column, name: str) -> Column:
    """Text of the first element of that local name, whatever its prefix."""
    return S.clean(unescaped(F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", 1)))


def attribute(xml: Column, name: str, key: str) -> Column:
    return F.nullif(unescaped(F.regexp_extract(xml, rf"""(?s)<(?:\w+:)?{name}\b[^>]*?\b{key}\s*=\s*["']([^"']*)["']""", 1)), F.lit(""))


def oai_records(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """One row a record of list pages: the page's columns but the text, position, identifier, datestamp, deleted, sets, fields.

    fields is an array of (key, value) in order, keys by local name; blank values go. A record without a
    header or identifier has error set. Null pages give no rows.
    """
    records = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?record(?:\s[^>]*)?>.*?</(?:\w+:)?record>"), F.lit(0))
    r = pages.select(*[c for c in pages.columns if c != xml], F.posexplode(records).alias("position", "raw_xml"))
    raw, header = F.col("raw_xml"), F.regexp_extract("raw_xml", r"(?s)<(?:\w+:)?header.*?</(?:\w+:)?header>", 0)
    body = F.regexp_extract(raw, r"(?s)<(?:\w+:)?metadata(?:\s[^>]*)?>(.*)</(?:\w+:)?metadata>", 1)
    pattern = F.lit(r"<(?:\w+:)?(\w+)(?:\s[^>]*)?>([^<]*)</")
    pairs = F.arrays_zip(F.regexp_extract_all(body, pattern, F.lit(1)).alias("key"), F.regexp_extract_all(body, pattern, F.lit(2)).alias("value"))
    fields = F.filter(F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), S.clean(unescaped(p["value"])).alias("value"))), lambda p: p["value"].isNotNull())
    identifier = element(header, "identifier")
    return r.withColumns(
        {
            "identifier": identifier, "datestamp": F.try_to_timestamp(element(header, "datestamp")), "deleted": F.coalesce(attribute(header, "header", "status") == "deleted", F.lit(False)),
            "sets": F.regexp_extract_all(header, F.lit(r"<(?:\w+:)?setSpec>([^<]*)<"), F.lit(1)), "fields": fields, "error": F.when(identifier.isNull(), "the record has no identifier"),
        }
    )


def oai_page_state(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """pages with error_code, error_class (empty, permanent, transient), token, complete_size, cursor, expires, records."""
    x = F.col(xml)
    code = attribute(x, "error", "code")
    kind = F.when(code == "noRecordsMatch", "empty").when(code.isin(*PERMANENT), "permanent").when(code.isNotNull(), "transient")
    return pages.withColumns(
        {
            "error_code": code, "error_class": kind, "token": element(x, "resumptionToken"), "complete_size": attribute(x, "resumptionToken", "completeListSize").try_cast("long"),
            "cursor": attribute(x, "resumptionToken", "cursor").try_cast("long"), "expires": F.try_to_timestamp(attribute(x, "resumptionToken", "expirationDate")), "records": F.regexp_count(x, F.lit(r"<(?:\w+:)?record[\s>]")),
        }
    )


def elements(xml: Column, name: str) -> Column:
    """Texts of all elements of that local name, in order, each with what it holds."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>"), F.lit(1))


#: What a repository says of itself, by element.
DESCRIPTION = {"repositoryName": "name", "baseURL": "base_url", "protocolVersion": "protocol", "earliestDatestamp": "earliest", "deletedRecord": "deleted_record", "granularity": "granularity"}


def repository_descriptions(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """One row an Identify answer: the page's columns but the text, the fields of DESCRIPTION, and admin_emails and compressions as lists."""
    d = pages.where(F.col(xml).rlike(r"<(?:\w+:)?Identify[\s>]"))
    lists = {n: F.filter(F.transform(elements(F.col(xml), e), lambda v: S.clean(unescaped(v))), lambda v: v.isNotNull()) for e, n in (("adminEmail", "admin_emails"), ("compression", "compressions"))}
    return d.withColumns({**{n: element(F.col(xml), e) for e, n in DESCRIPTION.items()}, **lists}).drop(xml)


def metadata_formats(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """One row a format of ListMetadataFormats answers: position, prefix, schema, namespace; those without a prefix go."""
    f = pages.select(*[c for c in pages.columns if c != xml], F.posexplode(elements(F.col(xml), "metadataFormat")).alias("position", "_f"))
    return f.withColumns({"prefix": element(F.col("_f"), "metadataPrefix"), "schema": element(F.col("_f"), "schema"), "namespace": element(F.col("_f"), "metadataNamespace")}).drop("_f").where("prefix is not null")


def set_descriptions(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """One row a set of ListSets answers: position, spec, name; a set without a name goes by its spec, one without a spec goes."""
    f = pages.select(*[c for c in pages.columns if c != xml], F.posexplode(elements(F.col(xml), "set")).alias("position", "_f"))
    return f.withColumns({"spec": element(F.col("_f"), "setSpec"), "name": F.coalesce(element(F.col("_f"), "setName"), element(F.col("_f"), "setSpec"))}).drop("_f").where("spec is not null")


def downloads(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """What a downloader takes of list pages: records that aren't deleted and have metadata, as (identifier, title, links), links without repeats in order."""
    r = oai_records(pages, xml).where(~F.col("deleted") & (F.size("fields") > 0) & F.col("error").isNull())
    values = lambda key: F.transform(F.filter("fields", lambda p: p["key"] == key), lambda p: p["value"])
    links = F.array_distinct(F.filter(F.concat(values("identifier"), values("relation"), values("source")), lambda v: F.lower(v).rlike(r"^https?://[^/\s?#]+")))
    return r.withColumns({"title": F.get(values("title"), F.lit(0)), "links": links}).drop("fields", "raw_xml", "sets", "error")


def completeness(states: DataFrame, source: str = "source") -> DataFrame:
    """Per source: pages, records landed and promised, tokens seen twice."""
    g = states.groupBy(source).agg(F.count("*").alias("pages"), F.sum("records").cast("long").alias("records"), F.max("complete_size").alias("promised"), (F.count("token") - F.count_distinct("token")).alias("repeated_tokens"))
    return g.withColumn("complete", F.col("promised").isNull() | (F.col("records") >= F.col("promised")))


def multimap(fields: Column) -> Column:
    """(key, value) pairs to key -> values in order."""
    keys = F.array_distinct(F.transform(fields, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(fields, lambda p: p["key"] == k), lambda p: p["value"])))


ITEM = "struct<id:string,uuid:string,handle:string,type:string,inArchive:boolean,withdrawn:boolean,discoverable:boolean,lastModified:string,metadata:string>"
HAL = f"struct<_embedded:struct<searchResult:struct<_embedded:struct<objects:array<struct<_embedded:struct<indexableObject:{ITEM}>>>>>>>"


def dspace_items(pages: DataFrame, json: str = "json", *, public_only: bool = False) -> DataFrame:
    """One row an item of landed discovery pages; only rows of type item; a missing flag counts as true.

    public_only leaves out what is withdrawn, not discoverable or not archived; else they are deleted rows.
    """
    objects = F.from_json(json, HAL)["_embedded"]["searchResult"]["_embedded"]["objects"]
    i = pages.select(*[c for c in pages.columns if c != json], F.explode(objects).alias("o")).select("*", "o._embedded.indexableObject.*").drop("o").where("type = 'item'")
    yes = lambda c: F.coalesce(c, F.lit(True))
    gone = F.coalesce("withdrawn", F.lit(False)) | ~yes(F.col("inArchive"))
    i = i.withColumns({"identifier": F.coalesce("uuid", "id", "handle"), "deleted": gone})
    return i.where(~gone & yes(F.col("discoverable"))) if public_only else i


def dspace_fields(items: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(identifier, key, position, value): names without dc. and by their common alias; language cut at - or _.

    A value may be a scalar, a list of scalars or a list of objects with a value.
    """
    each = items.select("identifier", F.explode(F.from_json(metadata, "map<string,string>")).alias("name", "raw"))
    lists = F.coalesce(F.from_json("raw", "array<struct<value:string>>"), F.transform(F.from_json("raw", "array<string>"), lambda v: F.struct(v.alias("value"))), F.array(F.struct(F.col("raw").alias("value"))))
    plain = F.when(F.forall(lists, lambda v: v["value"].isNull()), F.transform(F.from_json("raw", "array<string>"), lambda v: F.struct(v.alias("value")))).otherwise(lists)
    short = F.regexp_replace("name", "^dc[.]", "")
    key = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p]), short), short)
    out = each.select("identifier", key.alias("key"), F.posexplode(plain).alias("position", "v")).select("identifier", "key", "position", S.clean(F.col("v.value")).alias("value")).where("value is not null")
    return out.withColumn("value", F.when(F.col("key") == "language", F.regexp_extract("value", "^([^-_]*)", 1)).otherwise(F.col("value")))


def import_rows(files: DataFrame, text: str = "content") -> DataFrame:
    """One row a record of JSON files: an array, or an object's records, else its items, else the object itself.

    record_index counts from 0 in its file; what isn't an object has error set.
    """
    t = F.col(text)
    body = F.coalesce(F.from_json(t, "struct<records:array<string>,items:array<string>>"), F.lit(None))
    rows = F.when(F.ltrim(t).startswith("["), F.from_json(t, "array<string>")).otherwise(F.coalesce(body["records"], body["items"], F.array(t)))
    out = files.select(*[c for c in files.columns if c != text], F.posexplode(rows).alias("record_index", "raw"))
    return out.withColumn("error", F.when(~F.coalesce(F.ltrim("raw").startswith("{"), F.lit(False)), "the record is not an object"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header; quoted fields may hold line breaks; bad rows keep their text in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def manifest(entries: DataFrame, path: str = "path", order: str = "position") -> DataFrame:
    """The last entry of each base name."""
    base = F.element_at(F.split(path, r"[/\\]"), -1)
    return entries.groupBy(base.alias("base")).agg(F.max_by(F.struct(*entries.columns), order).alias("e")).select("base", "e.*")


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF and DOCX files with size, checksum and type by their first bytes."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,docx}").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 4))
    return f.select("path", "modificationTime", "length", F.sha2("content", 256).alias("checksum"), F.when(head == "25504446", "pdf").when(head == "504B0304", "docx").alias("kind"))


READERS = {"oai_pmh": oai_records, "dspace": dspace_items, "json": import_rows}
