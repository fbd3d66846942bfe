"""Column functions of single fields: dates of runs, addresses, file names and types, labelled texts, publishers' values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars as S

#: Types of files by what a server says, by their first bytes, and by the end of a name.
MIME = {"application/pdf": ".pdf", "application/msword": ".doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx"}
MAGIC = {"255044462D": ".pdf", "504B0304": ".docx", "D0CF11E0A1B11AE1": ".doc"}
EXTENSIONS = (".pdf", ".doc", ".docx")


def run_time(c: Column, now: Column) -> Column:
    """An ISO timestamp, one without a zone as UTC; what is missing or wrong is the time of the run."""
    x = F.trim(c)
    zoned = F.when(x.rlike(r"(Z|[+-]\d{2}:?\d{2})$") | ~x.rlike(r"\d{2}:\d{2}"), x).otherwise(F.concat(x, F.lit("Z")))
    return F.coalesce(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), zoned.try_cast("timestamp")), now)


def first_date(*columns: Column) -> Column:
    """The first value that is a date."""
    return F.coalesce(*[S.date(c) for c in columns])


def listed(*columns: Column) -> Column:
    """Values of several lists, one list after the other, without blanks."""
    every = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns]))
    return F.filter(every, lambda v: F.coalesce(v != "", F.lit(False)))


def source_urls(article: Column, pdf: Column, identifiers: Column) -> Column:
    """The article's and the file's address, then those identifiers that are addresses, each once."""
    web = F.filter(identifiers, lambda v: v.startswith("http://") | v.startswith("https://"))
    own = F.filter(F.array(article, pdf), lambda v: F.coalesce(v != "", F.lit(False)))
    return F.concat(own, F.array_except(F.coalesce(web, F.array().cast("array<string>")), own))


def handle(c: Column) -> Column:
    """The handle, prefix and number, of a resolver's or a repository's address."""
    return S.extracted(F.regexp_extract(c, r"(?i)^https?://(?:hdl\.handle\.net|[^/]+/handle)/(.+)$", 1), r"^\d[\d.]*/[^\s?#]+")


def managed_handle(c: Column, base: str) -> Column:
    """A handle's address at the managed host; other addresses stay."""
    return F.coalesce(F.concat(F.lit(base.rstrip("/") + "/handle/"), handle(c)), c)


def url_name(c: Column) -> Column:
    """The last part of an address's path, unescaped."""
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.nullif(F.trim(F.try_url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))), F.lit(""))


def extension(name: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(name, r"(?<=[^.])(\.[^./\\]+)$", 1), F.lit("")))


def safe_name(c: Column, fallback: str = "document", most: int = 140) -> Column:
    """A file name: signs that file systems forbid as _, white space collapsed, no blanks or dots at the ends."""
    bare = lambda x: F.regexp_replace(x, r"^[ .]+|[ .]+$", "")
    x = F.regexp_replace(F.regexp_replace(c, r'[<>:/\\|?*\x00-\x1f"]', "_"), r"(?U)\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(bare(x), F.lit(most)), r"[ .]+$", ""), F.lit("")), F.lit(fallback))


def file_type(mime: Column, head: Column, name: Column, address: Column) -> Column:
    """By the MIME type, else the first bytes, else the end of the name or of the address."""
    said = F.try_element_at(F.create_map(*[F.lit(x) for p in MIME.items() for x in p]), F.lower(F.trim(F.element_at(F.split(mime, ";"), 1))))
    seen = F.lit(None).cast("string")
    for sign, kind in reversed(MAGIC.items()):
        seen = F.when(F.hex(head).startswith(sign), kind).otherwise(seen)
    ends = [F.when(extension(c).isin(*EXTENSIONS), extension(c)) for c in (name, url_name(address))]
    return F.coalesce(said, seen, *ends)


def without_markup(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"(?U)\s+", " "))


def labelled_text(parts: dict[str, Column], most: int = 30_000, twice: str | None = None) -> Column:
    """Sections 'Label:' and its values, each value once over all sections, case aside; `twice` is said twice.

    parts: arrays of strings by label, in order. What is left of no section is null.
    """
    tidy = {label: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), without_markup), lambda x: F.coalesce(x != "", F.lit(False))) for label, a in parts.items()}
    before, sections = F.array().cast("array<string>"), []
    fresh = lambda a, taken: F.filter(a, lambda x: ~F.array_contains(taken, F.lower(x)))
    for label, a in tidy.items():
        own = S.distinct_folded(fresh(a, before))
        text = F.array_join(own, "; ")
        text = F.concat(text, F.lit("\n"), text) if label == twice else text
        sections.append(F.when(F.size(own) > 0, F.concat(F.lit(f"{label}:\n"), text)))
        before = F.concat(before, F.transform(own, F.lower))
    return F.nullif(F.rtrim(F.left(F.concat_ws("\n\n", *sections), F.lit(most))), F.lit(""))


def import_key(external_id: Column, uuid: Column, handle_column: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (external_id, uuid, handle_column)])


def json_safe(c: Column, kind: T.DataType) -> Column:
    """A value of any type with dates and times in ISO form and decimals as text, at any depth; keys of maps become text. Nulls stay.

    A time has six digits of fraction if it has any, and the session's offset unless it is without a zone.
    """
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zone = "xxx" if isinstance(kind, T.TimestampType) else ""
        return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, f"yyyy-MM-dd'T'HH:mm:ss{zone}")).otherwise(F.date_format(c, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}"))
    if isinstance(kind, T.DecimalType):
        return c.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), json_safe(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[json_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def shares(given: dict[str, Column], default: dict[str, float]) -> dict[str, Column]:
    """Weights by row that sum to one: nulls and names not given take the default, negatives count as none, nothing left means the defaults."""
    raw = {k: F.greatest(F.coalesce(given[k].cast("double"), F.lit(v)), F.lit(0.0)) if k in given else F.lit(max(v, 0.0)) for k, v in default.items()}
    total, whole = sum(raw.values(), F.lit(0.0)), sum(default.values())
    return {k: F.when(total > 0, raw[k] / total).otherwise(F.lit(v / whole)) for k, v in default.items()}
