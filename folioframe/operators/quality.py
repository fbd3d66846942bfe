"""Metadata quality in six dimensions, as one projection over publications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Shares of the dimensions in the final score.
WEIGHTS = {"completeness": 0.30, "validity": 0.20, "consistency": 0.15, "uniqueness": 0.15, "timeliness": 0.10, "accessibility": 0.10}
#: Texts that stand for no value.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "tbd", "test", "untitled", "no title", "not available", "no abstract", "no abstract available", "abstract")
#: Parts of the texts of known licences.
LICENCES = ("creative commons", "cc by", "creativecommons.org", "open access")
#: Fixed value: a language code with at most one further part.
LANGUAGE = r"(?i)^[a-z]{2,3}(-[a-z0-9]{2,8})?$"
#: Lists of issues in a report.
LISTS = ("missing_fields", "validation_errors", "warnings", "recommendations")


@dataclass(frozen=True)
class Check:
    """A rule: `passed` counts for the score, `issue` is what it says if it fails, and `says` when (if that differs)."""

    dimension: str
    name: str
    passed: Column
    issue: str | None = None
    message: Column | str = ""
    says: Column | None = None


def present(c: Column) -> Column:
    return F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))


def checks(as_of: str) -> list[Check]:
    """35 checks over the columns of a publication at a given time.

    issue is one of missing, error and warning. Null is what a missing value is: rules that ask for one
    fail without a further issue, others pass. Names, messages and limits of the checks are fixed values.
    """
    now = F.lit(as_of).cast("timestamp")
    c = F.col
    text = lambda n: F.coalesce(S.clean(c(n)), F.lit(""))
    placeholder = lambda n: F.lower(text(n)).isin(*PLACEHOLDERS)
    web = lambda x: x.rlike(r"(?i)^https?://[^/?#]+")
    list_of = lambda n: F.coalesce(c(n), F.array().cast("array<string>"))
    some = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    authors, keywords, subjects = list_of("authors"), list_of("keywords"), list_of("subjects")
    urls = some(F.concat(list_of("source_urls"), F.array("article_url", "pdf_url")))
    bad_urls = F.filter(urls, lambda u: ~web(u))
    bad_orcids = F.filter(some(list_of("orcids")), lambda o: S.orcid(o, False).isNull())
    year = F.coalesce(c("publication_year"), F.year("publication_date"))
    title, abstract = text("title"), text("abstract")
    distinct = lambda a: F.size(F.array_distinct(F.transform(some(a), lambda x: F.coalesce(S.identity(x), F.lit(""))))) == F.size(some(a))
    clean = lambda a: ~F.exists(a, lambda x: ~x.eqNullSafe(S.clean(x)))
    apart = ~F.coalesce(present(c("pdf_url")) & present(c("article_url")) & (F.lower(F.trim("pdf_url")) == F.lower(F.trim("article_url"))), F.lit(False))
    licence_url = F.when(present(c("license_url")), c("license_url")).when(web(c("license")), c("license"))
    licence = F.lower(F.concat_ws(" ", *[F.nullif(c(n), F.lit("")) for n in ("license", "license_name", "license_url")]))
    known = F.exists(F.array(*map(F.lit, LICENCES)), lambda s: F.contains(licence, s))
    swapped = (F.contains(F.lower(text("publisher")), F.lit("journal")) | F.contains(F.lower(text("publisher")), F.lit("bulletin"))) & (F.contains(F.lower(text("journal")), F.lit("university")) | F.contains(F.lower(text("journal")), F.lit("college")))
    short, weak = F.length(title) < 8, placeholder("abstract") | (F.length(abstract) < 20)
    later = lambda a, b: F.coalesce(a > b, F.lit(False))
    off = later(F.lit(1800), year) | later(year, F.year(now) + 1)
    stale = F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp("harvested_at")) / 86400) > 365, F.lit(False))
    doi_ok = ~present(c("doi")) | S.doi(c("doi")).isNotNull()
    language_ok = ~present(c("language")) | F.trim("language").rlike(LANGUAGE)
    no_date_match = F.coalesce(F.year("publication_date") != F.nullif("publication_year", F.lit(0)), F.lit(False))
    out = [
        Check("completeness", "title", title != "", "missing"),
        Check("completeness", "authors", F.size(authors) > 0, "missing"),
        Check("completeness", "abstract", abstract != "", "missing"),
        Check("completeness", "publication_date", c("publication_date").isNotNull() | c("publication_year").isNotNull(), "missing"),
        Check("completeness", "repository_identifier", present(c("repository_identifier")), "missing"),
        Check("completeness", "external_id", present(c("external_id")), "missing"),
        Check("completeness", "source_provenance", present(c("source")) & present(c("source_type")), "missing"),
        Check("completeness", "raw_metadata", present(c("raw_record")), "missing"),
        Check("validity", "placeholder_title", ~placeholder("title") & ~short, "error", "Title is placeholder text.", placeholder("title") & (title != "")),
        Check("", "short_title", F.lit(True), "error", "Title is too short to be descriptive.", ~placeholder("title") & short & (title != "")),
        Check("", "long_title", F.lit(True), "warning", "Title is unusually long.", F.length(title) > 500),
        Check("validity", "weak_abstract", ~weak, "warning", "Abstract is missing or not descriptive.", weak & (abstract != "")),
        Check("validity", "invalid_publication_year", year.isNotNull() & ~off, "error", said("Publication year is unreasonable: ", year.cast("string"), "."), off),
        Check("validity", "invalid_doi", doi_ok, "error", said("DOI is invalid: ", c("doi"), ".")),
        Check("validity", "invalid_orcid", F.size(bad_orcids) == 0, "error", said("Invalid ORCID values: ", F.array_join(bad_orcids, ", "), ".")),
        Check("validity", "invalid_url", F.size(bad_urls) == 0, "error", said("Invalid HTTP/HTTPS URLs: ", F.array_join(bad_urls, ", "), ".")),
        Check("validity", "invalid_language", language_ok, "error", said("Language code is invalid: ", c("language"), ".")),
        Check("validity", "empty_author_name", ~F.exists(authors, lambda a: S.clean(a).isNull()), "error", "One or more author names are empty."),
        Check("validity", "invalid_license_url", licence_url.isNull() | web(licence_url), "error", said("License URL is invalid: ", licence_url, ".")),
        Check("consistency", "date_year_mismatch", ~no_date_match, "warning", "Publication date year does not match publication_year."),
        Check("consistency", "publisher_journal_swapped", ~swapped, "warning", "Publisher and journal fields appear to be swapped."),
        Check("consistency", "unnormalized_keywords", clean(keywords), "warning", "Keyword values need normalization."),
        Check("consistency", "unnormalized_subjects", clean(subjects), "warning", "Subject values need normalization."),
        Check("consistency", "pdf_matches_article_url", apart, "warning", "PDF URL is not distinguishable from article URL."),
        Check("uniqueness", "duplicate_authors", distinct(authors), "warning", "Duplicate author values were detected."),
        Check("uniqueness", "duplicate_keywords", distinct(keywords), "warning", "Duplicate keyword values were detected."),
        Check("uniqueness", "duplicate_urls", distinct(urls), "warning", "Duplicate url values were detected."),
        Check("timeliness", "future_harvested_at", c("harvested_at").isNotNull() & ~later(c("harvested_at"), now), "error", "harvested_at is in the future.", later(c("harvested_at"), now)),
        Check("timeliness", "future_repository_datestamp", ~later(c("repository_datestamp"), now), "error", "repository_datestamp is in the future."),
        Check("timeliness", "repository_datestamp_after_harvest", ~later(c("repository_datestamp"), c("harvested_at")), "warning", "Repository datestamp is later than harvested_at."),
        Check("timeliness", "future_publication_year", c("publication_year").isNotNull() & ~later(c("publication_year"), F.year(now) + 1), "error", said("Publication year is in the future: ", c("publication_year").cast("string"), "."), later(c("publication_year"), F.year(now) + 1)),
        Check("timeliness", "stale_harvest", c("harvested_at").isNotNull() & ~stale, "warning", "Publication has not been harvested in over a year.", stale),
        Check("", "harvested_at", c("harvested_at").isNotNull(), "missing"),
        Check("accessibility", "article_url", present(c("article_url")), "missing"),
        Check("accessibility", "", F.size(bad_urls) == 0),
        Check("accessibility", "", apart),
        Check("accessibility", "missing_license", known, "warning", "License metadata is missing.", licence == ""),
        Check("", "unrecognized_license", F.lit(True), "warning", "License metadata is not recognized.", (licence != "") & ~known),
        Check("accessibility", "", distinct(urls)),
        Check("", "record_deleted", F.lit(True), "warning", "Deleted source records are assessed separately from active averages.", F.coalesce(c("is_deleted"), F.lit(False))),
    ]
    return out


def assessed(pubs: DataFrame, as_of: str, given: dict[str, float] | None = None) -> DataFrame:
    """pubs with a score a dimension, final_score, grade and lists of issues in the order of the rules; one pass, no shuffle.

    missing_fields are names; validation_errors and warnings are 'type: message'; recommendations follow
    what is missing; issue_types are the types of all three.
    """
    share = S.weights(given, WEIGHTS)
    every = checks(as_of)
    failed = [F.lit(False) if k.issue is None else F.coalesce(k.says if k.says is not None else ~k.passed, F.lit(False)) for k in every]
    flags = pubs.withColumn("_passed", F.array(*[F.coalesce(k.passed, F.lit(False)) for k in every])).withColumn("_failed", F.array(*failed))
    score = {}
    for d in WEIGHTS:
        own = [i for i, k in enumerate(every) if k.dimension == d]
        score[f"{d}_score"] = S.bounded(sum((F.get("_passed", F.lit(i)).cast("int") for i in own), F.lit(0)) * 100.0 / len(own))
    out = flags.withColumns(score)

    def issues_of(*kinds: str, told: bool = False) -> Column:
        def one(i: int, k: Check) -> Column:
            message = k.message if isinstance(k.message, Column) else F.lit(k.message)
            if told:
                return F.concat(F.lit(f"{k.name}: "), message)
            return F.lit(f"missing_{k.name}" if "error" in kinds and k.issue == "missing" else k.name)

        return F.array_compact(F.array(*[F.when(F.get("_failed", F.lit(i)), one(i, k)) for i, k in enumerate(every) if k.issue in kinds]))

    advice = F.transform("missing_fields", lambda n: F.when(n == "harvested_at", "Persist harvested_at for provenance.").otherwise(F.concat(F.lit("Provide "), F.translate(n, "_", " "), F.lit(" metadata."))))
    out = out.withColumns({"final_score": S.bounded(sum((F.col(f"{d}_score") * w for d, w in share.items()), F.lit(0.0))), "missing_fields": issues_of("missing"), "validation_errors": issues_of("error", told=True), "warnings": issues_of("warning", told=True), "issue_types": issues_of("missing", "error", "warning")})
    return out.withColumns({"grade": S.grade(F.col("final_score")), "recommendations": advice}).drop("_passed", "_failed")


def issues(reports: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    """One row an issue: (key, category, issue_type, message); kind keeps one type, or one message."""
    names = dict(zip(LISTS, ("missing_field", "validation_error", "warning", "recommendation")))
    shown = {n: F.transform(n, lambda x: F.concat(F.lit("missing_"), x)) if n == "missing_fields" else F.col(n) for n in LISTS}
    groups = F.array(*[F.struct(F.lit(names[n]).alias("category"), c.alias("messages")) for n, c in shown.items()])
    out = reports.select(key, F.explode(groups).alias("g")).select(key, "g.category", F.explode("g.messages").alias("message"))
    out = out.withColumn("issue_type", S.issue_type(F.col("message")))
    return out.where((F.col("issue_type") == kind) | (F.col("message") == kind)) if kind else out
