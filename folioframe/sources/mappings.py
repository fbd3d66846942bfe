"""Records whose values may be a scalar, a list or an object, read as variants: import rows, repository items, manifests.

Text that is no JSON, and an object that names a key twice, is null to the parser; each reader says what it makes of that.
Numbers lose noughts at the end of their fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<string>"


def stripped(c: Column) -> Column:
    """Without white space at both ends; nothing left is null."""
    return F.nullif(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(""))


def let(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def items(v: Column) -> Column:
    """The elements of a list; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def told(v: Column) -> Column:
    """A value as text; null, false, zero and what is empty are null, as a missing value is."""

    def by_kind(x: Column, kind: Column) -> Column:
        text = F.try_variant_get(x, "$", "string")
        number = F.when(F.try_variant_get(x, "$", "double") != 0, text)
        return F.when(kind == "VOID", F.lit(None)).when(kind == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), "True")).when(kind.rlike("^(STRING|ARRAY|OBJECT)"), let(text, lambda t: F.when(~t.isin("", "[]", "{}"), t))).otherwise(number)

    return let(v, lambda x: let(F.schema_of_variant(x), lambda kind: by_kind(x, kind)))


def _worded(v: Column) -> Column:
    """An object goes by its value, else its text, else its name."""
    return stripped(F.when(is_object(v), F.coalesce(*[told(at(v, k)) for k in ("value", "text", "name")])).otherwise(told(v)))


def _texts(own: Column, inner: Column) -> Column:
    nothing = own.isNull() | F.coalesce(F.try_variant_get(own, "$", "string").isin("", "[]"), F.lit(True))
    return let(F.when(nothing, inner).otherwise(own), lambda v: F.filter(F.transform(F.coalesce(items(v), F.array(v)), _worded), lambda t: t.isNotNull()))


def texts_under(row: Column, metadata: Column, keys: list[str]) -> Column:
    """For each key the texts under it, from metadata if the row has nothing there."""
    pairs = F.array(*[F.struct(at(row, k).alias("own"), at(metadata, k).alias("inner")) for k in keys])
    return F.transform(pairs, lambda p: _texts(p["own"], p["inner"]))


def _first_of(lists: Column) -> Column:
    return F.coalesce(F.get(F.filter(lists, lambda a: F.size(a) > 0), F.lit(0)), F.array().cast(EMPTY))


def alias_values(row: Column, metadata: Column, *keys: str) -> Column:
    """The texts under the first of the keys that has any; a key is looked up in metadata if the row has nothing there."""
    return _first_of(texts_under(row, metadata, list(keys)))


#: The names of each field of import rows, in order.
ONE = {
    "title": ("title", "dc.title", "name"), "abstract": ("abstract", "dc.description.abstract"), "publisher": ("publisher", "dc.publisher"), "language": ("language", "languages", "dc.language", "dc.language.iso"),
    "doi": ("doi", "dc.identifier.doi"), "article_url": ("article_url", "url", "landing_page_url", "dc.identifier.uri"), "_year": ("publication_year", "year", "publication_date", "dc.date.issued"),
}
MANY = {"authors": ("authors", "dc.contributor.author", "dc.creator"), "affiliations": ("affiliations", "dc.contributor.advisor"), "keywords": ("keywords", "dc.subject"), "subjects": ("subjects", "dc.subject")}
#: Fields read from the row alone.
OWN = {"external_id": ("external_id", "uuid", "handle"), "journal": ("journal", "journal_name"), "license": ("rights",), "pdf_url": ("pdf_url",), "repository_identifier": ("external_id",)}
_WORK = ("_row", "_texts", "_own", "_split", "_year")
NO_TITLE, NO_OBJECT = "A record is missing its title", "the record is not an object"


def _split(v: Column) -> Column:
    """A plain text split at , and ;; null for anything else."""
    return F.when(is_text(v), F.filter(F.transform(F.split(F.try_variant_get(v, "$", "string"), "[,;]"), stripped), lambda t: t.isNotNull()))


def publications(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Import rows (JSON text) as publications beside the rows' other columns; columns named as a field are replaced.

    Null, empty and broken text and whatever is no object get NO_OBJECT as error, objects without a title NO_TITLE;
    such rows stay, with what they have. Lists given as one plain text are split at , and ;. Repeated rows stay as they are. A year is what the first date begins with.
    """
    kept = [c for c in rows.columns if c not in {*ONE, *MANY, *OWN, "publication_year", "publication_date", "is_deleted", "error", *_WORK}]
    keys, own = (list(dict.fromkeys(k for n in names for k in n)) for names in ([*ONE.values(), *MANY.values()], [*OWN.values(), ("is_deleted",)]))
    row = F.col("_row")
    r = rows.withColumn("_row", F.try_parse_json(raw)).select(*kept, "_row")
    r = r.withColumns({"_texts": texts_under(row, at(row, "metadata"), keys), "_own": F.transform(F.array(*[at(row, k) for k in own]), told), "_split": F.array(*[_split(at(row, k)) for k in MANY])})
    found = lambda names: _first_of(F.array(*[F.get("_texts", F.lit(keys.index(n))) for n in names]))
    said = lambda name: F.get("_own", F.lit(own.index(name)))
    fields = {k: F.get(found(n), F.lit(0)) for k, n in ONE.items()} | {k: F.coalesce(F.get("_split", F.lit(i)), found(n)) for i, (k, n) in enumerate(MANY.items())}
    fields |= {k: stripped(F.coalesce(*[said(x) for x in n])) for k, n in OWN.items()}
    out = r.withColumns(fields | {"is_deleted": said("is_deleted").isNotNull(), "error": F.when(~is_object(row), NO_OBJECT)})
    year = F.nullif(F.regexp_extract(F.left("_year", F.lit(4)), "^[0-9]+$", 0), F.lit("")).cast("int")
    out = out.withColumns({"publication_year": year, "keywords": F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.col("subjects")), "error": F.coalesce("error", F.when(F.col("title").isNull(), NO_TITLE))})
    return out.withColumn("publication_date", F.when(F.col("publication_year") > 0, F.make_date("publication_year", F.lit(1), F.lit(1)))).drop(*_WORK)


def _bare(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "^/+|/+$", ""), F.lit(""))


def handle(c: Column) -> Column:
    """The handle that an address or a bare handle names; null if none."""
    return let(stripped(c), _handle)


def _handle(x: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace(x, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", ""), r"(?s)^[^?#]*", 0), r";[^/]*$", "")
    return (
        F.when(x.rlike("^https?://hdl[.]handle[.]net/"), _bare(F.regexp_replace(x, "^https?://hdl[.]handle[.]net/", "")))
        .when(F.contains(path, F.lit("/handle/")), _bare(F.regexp_extract(path, "(?s)^.*?/handle/(.*)$", 1))).when(F.contains(x, F.lit("/")), _bare(x))
    )


def metadata_values(item: Column, key: str) -> Column:
    """The different values under a key of an item's metadata; only objects in lists have any."""
    entries = F.filter(F.coalesce(items(at(at(item, "metadata"), key)), F.array().cast("array<variant>")), is_object)
    return F.array_distinct(F.filter(F.transform(entries, lambda e: stripped(told(at(e, "value")))), lambda t: t.isNotNull()))


def landing_records(rows: DataFrame, base_url: Column, prefix: str | None = None, item: str = "item") -> DataFrame:
    """Repository items (JSON text) as landing records: item_uuid, handle, title, authors, issued_date, landing_url, identifiers, external_id.

    With a prefix a record goes by prefix and handle, else uuid, and its page is that of the handle, else of the item.
    Without one it goes by the uuid, and its page is the first identifier, else that of its own handle, else of the item.
    Items without an id, null and broken text give no row. Columns of the same names are replaced.
    """
    v, ids = F.col("_item"), metadata_values(F.col("_item"), "dc.identifier.uri")
    named = {"item_uuid", "handle", "title", "authors", "issued_date", "landing_url", "identifiers", "external_id"}
    r = rows.withColumns({"_item": F.try_parse_json(item), "_base": F.rtrim(base_url, F.lit("/"))}).select(*[c for c in rows.columns if c not in named | {item, "_item", "_base"}], "_item", "_base")
    own = stripped(told(at(v, "handle")))
    r = r.withColumns({
        "item_uuid": stripped(F.coalesce(told(at(v, "uuid")), told(at(v, "id")))), "_ids": ids, "handle": F.coalesce(handle(told(at(v, "handle"))), F.get(F.filter(F.transform(ids, handle), lambda h: h.isNotNull()), F.lit(0))),
        "title": F.coalesce(F.get(metadata_values(v, "dc.title"), F.lit(0)), stripped(told(at(v, "name")))), "authors": metadata_values(v, "dc.contributor.author"), "issued_date": F.get(metadata_values(v, "dc.date.issued"), F.lit(0)),
    }).where("item_uuid is not null")
    page = lambda h: F.coalesce(F.concat("_base", F.lit("/handle/"), h), F.concat("_base", F.lit("/items/"), "item_uuid"))
    if prefix is None:
        r = r.withColumns({"landing_url": F.coalesce(F.get("_ids", F.lit(0)), page(own)), "identifiers": F.col("_ids"), "external_id": F.col("item_uuid")})
    else:
        r = r.withColumn("landing_url", page(F.col("handle")))
        r = r.withColumns({"identifiers": F.array_distinct(F.concat("_ids", F.array("landing_url"))), "external_id": F.concat(F.lit(f"{prefix}:"), F.coalesce("handle", "item_uuid"))})
    return r.drop("_item", "_base", "_ids")


def landing_url(identifier: Column, links: Column) -> Column:
    """The page of a record among its links: one that ends with the identifier's last part, else one of a handle or an item, else the first."""
    suffix = F.element_at(F.split(identifier, ":"), -1)
    web = F.filter(links, lambda u: u.rlike("^https?://"))
    first = lambda good: F.get(F.filter(web, good), F.lit(0))
    return F.coalesce(first(lambda u: F.endswith(F.rtrim(u, F.lit("/")), suffix)), first(lambda u: F.contains(u, F.lit("handle")) | F.contains(u, F.lit("/items/"))), F.get(web, F.lit(0)))


def manifest_entries(files: DataFrame, content: str = "content") -> DataFrame:
    """The entries of download manifests beside the files' columns: base, path, position, entry (a variant), the last of each base name in its file.

    A manifest is a list, or an object with documents, items or entries, or an object of entries by any key. What has
    no path or is no object goes; null, empty and broken files give no rows. A file is one row here, as it was landed.
    """
    kept = [c for c in files.columns if c not in {content, "base", "path", "position", "entry"}]
    text = F.col(content)
    inner, by_key = F.try_parse_json(text), F.from_json(text, "map<string,string>")
    # values of an object in the order of the text, which a variant doesn't keep
    of = lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).when(F.ltrim(c).startswith("{"), F.map_values(F.from_json(c, "map<string,string>")))
    part = F.coalesce(*[F.when(told(at(inner, k)).isNotNull(), F.try_element_at(by_key, F.lit(k))) for k in ("documents", "items", "entries")])
    named = F.when(is_object(inner), of(F.coalesce(part, text))).when(items(inner).isNotNull(), of(text))
    e = files.select(*kept, F.posexplode(named).alias("position", "_raw")).withColumn("entry", F.try_parse_json("_raw")).where(is_object(F.col("entry"))).drop("_raw")
    e = e.withColumn("path", F.coalesce(*[told(at(F.col("entry"), k)) for k in ("local_path", "path", "final_path")]))
    e = e.withColumn("base", F.nullif(F.regexp_extract("path", "([^/]*)/*$", 1), F.lit(""))).where("base is not null")
    return e.groupBy(*kept, "base").agg(F.max_by(F.struct("position", "path", "entry"), "position").alias("_e")).select(*kept, "base", "_e.*")


def array_entries(files: DataFrame, content: str = "content") -> DataFrame:
    """One row a landed JSON file: records (objects), skipped (other entries), error if the file holds no array; empty arrays are whole."""
    v = items(F.try_parse_json(content))
    objects = F.size(F.filter(v, is_object))
    return files.withColumns({"records": F.when(v.isNotNull(), objects), "skipped": F.when(v.isNotNull(), F.size(v) - objects), "error": F.when(v.isNull(), "the file must contain a JSON array")}).drop(content)
