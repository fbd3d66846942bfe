"""Parsed records to the canonical publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Names of publishers that go by several.
PUBLISHERS = {"aau": "Addis Ababa University", "addis ababa university press": "Addis Ababa University", "haramaya univ.": "Haramaya University"}


def values(m: Column, *keys: str) -> Column:
    """The values of several keys of a multimap, one key after the other."""
    return F.flatten(F.array(*[F.coalesce(F.try_element_at(m, F.lit(k)), F.array().cast("array<string>")) for k in keys]))


def first(a: Column) -> Column:
    return F.get(F.filter(F.transform(a, S.clean), lambda x: x.isNotNull()), F.lit(0))


def publisher(c: Column, most: int = 255) -> Column:
    folded = F.lower(S.clean(c))
    known = F.create_map(*[F.lit(x) for p in PUBLISHERS.items() for x in p])
    return F.left(F.coalesce(F.try_element_at(known, folded), S.clean(c)), F.lit(most))


def canonical(records: DataFrame, fields: str = "m") -> DataFrame:
    """records (identifier, source, datestamp, deleted, and a multimap by Dublin Core names) as publications.

    Dates come from date, issued and available; authors from creator, author and contributor.author, else
    contributor; addresses from identifier, relation and source: the first .pdf is the file, the first
    other the landing page. A deleted record has a null title.
    """
    m = F.col(fields)
    dates = values(m, "date", "issued", "available", "date.issued", "date.available")
    people = values(m, "creator", "author", "contributor.author")
    people = F.when(F.size(people) > 0, people).otherwise(values(m, "contributor"))
    ids = values(m, "identifier", "relation", "source", "bibliographicCitation")
    urls = F.filter(F.transform(ids, S.url), lambda u: F.coalesce(u.rlike("^https?://"), F.lit(False)))
    subjects = S.distinct_folded(F.flatten(F.transform(values(m, "subject"), S.terms)))
    day = F.get(F.filter(F.transform(dates, S.date), lambda d: d.isNotNull()), F.lit(0))
    return records.select(
        "source", F.col("identifier").alias("external_id"), S.title(first(values(m, "title"))).alias("title"), first(values(m, "description", "abstract", "description.abstract")).alias("abstract"),
        S.distinct_folded(F.filter(F.transform(people, S.author_name), lambda a: a.isNotNull())).alias("authors"), day.alias("publication_date"),
        F.coalesce(F.year(day), F.get(F.filter(F.transform(dates, S.year), lambda y: y.isNotNull()), F.lit(0))).alias("publication_year"),
        subjects.alias("subjects"), subjects.alias("keywords"), S.language(first(values(m, "language"))).alias("language"), publisher(first(values(m, "publisher"))).alias("publisher"),
        F.get(F.filter(F.transform(ids, S.doi), lambda x: x.isNotNull()), F.lit(0)).alias("doi"), F.get(F.filter(F.transform(values(m, "identifier"), S.issn), lambda x: x.isNotNull()), F.lit(0)).alias("issn"),
        F.get(F.filter(urls, lambda u: F.lower(u).endswith(".pdf")), F.lit(0)).alias("pdf_url"), F.get(F.filter(urls, lambda u: ~F.lower(u).endswith(".pdf")), F.lit(0)).alias("article_url"),
        first(values(m, "rights", "license")).alias("license"), first(values(m, "isPartOf", "source")).alias("journal"), F.col("deleted").alias("is_deleted"), F.col("datestamp").alias("repository_datestamp"),
    )


#: Names that a field goes by in import rows, in order.
FIELD_NAMES = {"title": ("title", "dc.title", "name"), "external_id": ("external_id", "uuid", "handle", "id"), "doi": ("doi", "dc.identifier.doi"), "year": ("publication_year", "year", "publication_date", "dc.date.issued"), "language": ("language", "dc.language"), "abstract": ("abstract", "dc.description.abstract", "description")}


def imported(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Import rows (JSON text) as fields; a field is the first of its names that has a value, bad rows get an error.

    A value may be a text, a list, or objects with value, text or name.
    """
    m = F.from_json(raw, "map<string,string>")

    def value(*names: str) -> Column:
        def plain(c: Column) -> Column:
            one = F.coalesce(F.get_json_object(c, "$[0].value"), F.get_json_object(c, "$[0].text"), F.get_json_object(c, "$[0].name"), F.get_json_object(c, "$[0]"), F.get_json_object(c, "$.value"), F.get_json_object(c, "$.name"))
            return S.clean(F.when(c.rlike(r"^\s*[\[{]"), one).otherwise(c))

        return F.coalesce(*[plain(F.try_element_at(F.col("_m"), F.lit(n))) for n in names])

    out = rows.withColumn("_m", m)
    out = out.withColumns({k: value(*n) for k, n in FIELD_NAMES.items()}).withColumn("publication_year", S.year(F.col("year"))).drop("_m", "year")
    missing = F.when(F.col("title").isNull(), "A record is missing its title")
    return out.withColumn("error", F.coalesce("error", missing) if "error" in rows.columns else missing)


ETD = "doc_id bigint, uuid string, handle string, title string, abstract string, publication_date string, authors array<string>, subjects array<string>, document_types array<string>, languages array<string>, identifiers array<string>, landing_page_url string, publisher string, withdrawn boolean"


def etd(rows: DataFrame, raw: str = "raw", default: str = "Thesis") -> DataFrame:
    """Harvested theses (JSON objects) as publications; one without a title goes.

    The external id is the uuid, else the handle; the repository's identifier the handle, else that.
    """
    r = rows.select(F.from_json(raw, ETD).alias("r")).select("r.*")
    some = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    key = F.coalesce(F.nullif(F.trim("uuid"), F.lit("")), F.nullif(F.trim("handle"), F.lit("")))
    day = S.tolerant_date(F.col("publication_date"))
    subjects = S.keyword_list(some(F.col("subjects")))
    out = r.select(
        "doc_id", key.alias("external_id"), S.title(F.col("title")).alias("title"), S.clean(F.col("abstract")).alias("abstract"), S.distinct_folded(some(F.col("authors"))).alias("authors"), publisher(F.col("publisher")).alias("publisher"),
        day.alias("publication_date"), F.year(day).alias("publication_year"), subjects.alias("keywords"), subjects.alias("subjects"), F.get(some(F.col("languages")), F.lit(0)).alias("language"), F.nullif(F.trim("landing_page_url"), F.lit("")).alias("article_url"),
        F.coalesce(F.nullif(F.trim("handle"), F.lit("")), key).alias("repository_identifier"), F.coalesce(F.get(some(F.col("document_types")), F.lit(0)), F.lit(default)).alias("publication_type"), F.coalesce("withdrawn", F.lit(False)).alias("is_deleted"),
    )
    return out.where("title is not null")
