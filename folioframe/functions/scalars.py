"""Column functions: clean, parse, extract, compare, grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and codes of languages, and what they mean.
LANGUAGES = {"en": "en", "eng": "en", "english": "en", "am": "am", "amh": "am", "amharic": "am", "om": "om", "orm": "om", "oromo": "om", "aa": "aa", "afar": "aa", "ti": "ti", "tir": "ti", "tigrinya": "ti"}
#: Text that was read in the wrong encoding, and what it stood for, in order.
MOJIBAKE = (("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€", '"'), ("â€“", "–"), ("â€”", "—"), ("â€¦", "…"), ("Â ", " "), ("Â", ""))


def clean(c: Column) -> Column:
    """White space collapsed to one space and trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def title(c: Column) -> Column:
    return F.nullif(F.regexp_replace(clean(c), "[ /:]+$", ""), F.lit(""))


def author_name(c: Column) -> Column:
    """'Last, First' to 'First Last'; the first comma parts them."""
    x = clean(c)
    turned = clean(F.concat_ws(" ", F.regexp_extract(x, r"^([^,]*),(.*)$", 2), F.regexp_extract(x, r"^([^,]*),(.*)$", 1)))
    return F.when(F.contains(x, F.lit(",")), turned).otherwise(x)


def extracted(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def doi(c: Column) -> Column:
    return F.lower(extracted(c, r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"))


def orcid(c: Column, checked: bool = True) -> Column:
    """The identifier; with `checked` only if its last sign is right (ISO 7064, modulus 11, base 2)."""
    found = F.upper(extracted(c, r"(?i)\b\d{4}-\d{4}-\d{4}-\d{3}[\dX]\b"))
    if not checked:
        return found
    digits = F.split(F.substring(F.regexp_replace(found, "-", ""), 1, 15), "")
    total = F.aggregate(digits, F.lit(0), lambda a, d: (a + F.coalesce(d.try_cast("int"), F.lit(0))) * 2)
    rest = (12 - total % 11) % 11
    return F.when(F.right(found, F.lit(1)) == F.when(rest == 10, "X").otherwise(rest.cast("string")), found)


def issn(c: Column) -> Column:
    return F.upper(extracted(c, r"(?i)\b\d{4}-\d{3}[\dX]\b"))


def language(c: Column) -> Column:
    folded = F.lower(clean(c))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, folded), folded)


def url(c: Column) -> Column:
    """Scheme and host in lower case, path and query as they are, no fragment and no parameters of the last part of the path; null without scheme or host."""
    pattern = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(c, pattern, k)
    return F.when(c.rlike(pattern), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(F.trim(part(3)), ";[^/]*$", ""), F.trim(part(4))))


def date(c: Column) -> Column:
    """A day, a month (its first) or anything that begins with a year (its first of January); else null."""
    x = F.trim(c)
    return (
        F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"))
        .when(x.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(x, F.lit("-01")), "yyyy-MM-dd"))
        .when(x.rlike(r"^\d{4}"), F.try_to_date(F.concat(F.substring(x, 1, 4), F.lit("-01-01")), "yyyy-MM-dd"))
    )


#: The forms in which dates are given, tried in this order, and an ending that is no part of them.
DATE_FORMS = ("yyyy-M-d", "yyyy-M", "yyyy", "M/d/yyyy", "M/d/yy", "MMMM, yyyy", "MMMM yyyy", "MMM, yyyy", "MMM yyyy")
DATE_ENDING = "aau"


def tolerant_date(c: Column, low: int = 1800, high: int = 2100) -> Column:
    """The day of a date in one of DATE_FORMS or of an ISO date and time, as it stands there; a month's or year's first. Two digits of a year are 1969 to 2068."""
    x = F.trim(F.regexp_replace(F.trim(c), f"(?i){DATE_ENDING}$", ""))
    x = F.regexp_replace(x, r"^0(?=\d{4}-\d{2}-\d{2}$)", "")
    short = x.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$")
    day = lambda f: F.to_date(F.try_to_timestamp(x, F.lit(f)))
    tried = F.coalesce(*[F.when(short, F.when(F.year(day(f)) > 2068, F.add_months(day(f), -1200)).otherwise(day(f))) if f == "M/d/yy" else F.when(~short, day(f)) for f in DATE_FORMS])
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}") & x.try_cast("timestamp").isNotNull(), F.try_to_date(F.left(x, F.lit(10)), "yyyy-MM-dd"))
    found = F.coalesce(tried, iso)
    return F.when(F.year(found).between(low, high), found)


def year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b(?:19|20)\d{2}\b", 0), F.lit("")).cast("int")


def distinct_folded(a: Column) -> Column:
    """The first spelling of each value, case aside, in order."""
    empty = F.array().cast("array<string>")
    return F.aggregate(a, empty, lambda done, x: F.when(F.exists(done, lambda y: F.lower(y) == F.lower(x)), done).otherwise(F.concat(done, F.array(x))))


def terms(c: Column) -> Column:
    """Split on ; and , cleaned, distinct case aside."""
    parts = F.transform(F.split(c, "[;,]"), clean)
    return distinct_folded(F.filter(parts, lambda x: x.isNotNull()))


def identity(c: Column) -> Column:
    return F.lower(clean(c))


def identity_title(c: Column) -> Column:
    return clean(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))


def keyword_list(a: Column, most: int = 255) -> Column:
    return distinct_folded(F.filter(F.transform(a, clean), lambda x: x.isNotNull() & (F.length(x) <= most)))


def bounded_title(c: Column, most: int = 1000) -> Column:
    x = clean(c)
    return F.when(F.length(x) <= most, x)


def metadata_hash(title: Column, publication_year: Column, doi_: Column, url_: Column, authors: Column) -> Column:
    """One hash of what a citation shows; nulls, and lists of names, stay apart from their neighbours."""
    return F.sha2(F.to_json(F.array(F.to_json(F.struct(title.alias("t"))), F.to_json(F.struct(publication_year.alias("y"))), F.to_json(F.struct(doi_.alias("d"))), F.to_json(F.struct(url_.alias("u"))), F.to_json(F.struct(authors.alias("a"))))), 256)


def first_value(*columns: Column) -> Column:
    return F.coalesce(*[clean(c) for c in columns])


def repaired(c: Column) -> Column:
    for wrong, right in MOJIBAKE:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def clean_lines(c: Column) -> Column:
    """Newlines alike, lines trimmed and collapsed, runs of blank lines as one."""
    x = F.regexp_replace(c, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_pages(c: Column) -> Column:
    """NUL to a space, words joined across line breaks, blanks collapsed, two newlines at most."""
    x = F.regexp_replace(c, r"\x00", " ")
    x = F.regexp_replace(x, r"(\w)-\n(\w)", "$1$2")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def without_markup(c: Column) -> Column:
    return clean(F.regexp_replace(c, r"<[^>]+>", " "))


def document_title(c: Column) -> Column:
    """A file's name without folders, extension, identifier or number in front."""
    base = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[A-Za-z0-9]{1,5}$", "")
    return clean(F.regexp_replace(F.regexp_replace(base, r"^(?:[0-9a-fA-F-]{36}|\d+)_", ""), "[_-]+", " "))


def embedding_text(title: Column, abstract: Column, subjects: Column) -> Column:
    def section(name: str, c: Column) -> Column:
        return F.when(clean(c).isNotNull(), F.concat(F.lit(f"{name}: "), clean(c)))

    return F.concat_ws("\n", section("Title", title), section("Abstract", abstract), section("Subjects", F.array_join(subjects, "; ")))


def tokens_by_bytes(c: Column) -> Column:
    pieces = F.size(F.regexp_extract_all(c, F.lit(r"\w+|[^\w\s]"), F.lit(0)))
    return F.greatest(F.lit(1), pieces, F.ceil(F.octet_length(c) / 3).cast("int"))


def tokens_by_words(c: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) * 1.3).cast("int"))


def tokens_by_characters(c: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(c) / 4).cast("int"))


def sentences(c: Column) -> Column:
    parts = F.split(c, r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def word_list(c: Column, pattern: str, stop: tuple[str, ...] = ()) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


#: Words that a search, an answer and a keyword list don't count.
SEARCH_STOP = ("what", "which", "show", "find", "about", "from", "with", "research", "studies", "papers", "paper", "study", "the", "and", "for", "does", "were", "was", "are", "is", "into", "that", "this")
ANSWER_STOP = ("what", "which", "the", "and", "for", "from", "with", "were", "was", "study", "research", "paper")


def search_tokens(c: Column) -> Column:
    """Words between white space without signs around them."""
    words = F.transform(F.split(F.lower(c), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"""^[.,?!:;()\[\]{}"']+|[.,?!:;()\[\]{}"']+$""", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*SEARCH_STOP))


def answer_tokens(c: Column) -> Column:
    """Runs of three ASCII letters or digits and more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda w: ~w.isin(*ANSWER_STOP))


def context_terms(c: Column) -> Column:
    """Runs of three word characters of any script and more."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w{3,}"), F.lit(0))


def counted(df: DataFrame, words: str) -> DataFrame:
    """df with _counts: array of (term, n, first) of a list of words, by term; sorted runs, so no shuffle and linear but for the sort."""
    out = df.withColumn("_sorted", F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("pos")))))
    at = lambda i: F.get("_sorted", i)
    places = F.sequence(F.lit(0), F.greatest(F.size("_sorted") - 1, F.lit(0)))  # of an empty list one run of none
    out = out.withColumn("_starts", F.filter(places, lambda i: (i == 0) | (at(i)["term"] != at(i - 1)["term"])))
    out = out.withColumn("_ends", F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(F.size("_sorted"))))
    runs = F.zip_with("_starts", "_ends", lambda a, b: F.struct(at(a)["term"].alias("term"), (b - a).cast("long").alias("n"), at(a)["pos"].cast("long").alias("first")))
    return out.withColumn("_counts", F.filter(runs, lambda r: r["n"] > 0)).drop("_sorted", "_starts", "_ends")


def each_count(df: DataFrame, keep: list[str], counts: str | Column = "_counts") -> DataFrame:
    """One row a count: keep and c. (An outer explode: for an inner one the optimiser adds a filter that counts again for every element.)"""
    return df.select(*keep, F.explode_outer(counts).alias("c")).where("c is not null")


def most_common(counts: Column, n: int, by_term: bool = False) -> Column:
    """The n most frequent of _counts, ties by first place or by term."""
    keyed = F.transform(counts, lambda c: F.struct((-c["n"]).alias("k"), (c["term"] if by_term else c["first"]).alias("tie"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["c"])


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def bounded(score: Column) -> Column:
    return F.least(F.greatest(F.round(score, 2), F.lit(0.0)), F.lit(100.0))


def weights(given: dict[str, float] | None, default: dict[str, float]) -> dict[str, float]:
    """Shares that sum to one; names not given keep their default, negatives count as none, nothing left means the defaults."""
    raw = {k: max(0.0, float((given or {}).get(k, v))) for k, v in default.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else weights(None, default)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def issue_type(c: Column) -> Column:
    x = F.regexp_replace(F.lower(F.regexp_extract(c, r"^([^:]*)", 1)), "[^a-z0-9_]+", "_")
    return F.left(F.regexp_replace(x, "^_+|_+$", ""), F.lit(80))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), F.lit(None)).when(end.isNull() | (start == end), F.concat(F.lit("Page "), start.cast("string"))).otherwise(F.concat(F.lit("Pages "), start.cast("string"), F.lit("-"), end.cast("string")))


def quick_score(required: list[Column], valuable: list[Column]) -> Column:
    missing = lambda cs: sum((F.when(clean(c.cast("string")).isNull(), 1).otherwise(0) for c in cs), F.lit(0))
    return F.greatest(F.lit(0), 100 - 14 * missing(required) - 5 * missing(valuable))


def first_pass_score(required: list[Column], optional: list[Column], doi_column: Column) -> Column:
    present = lambda cs: sum((F.when(clean(c.cast("string")).isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    return F.least(F.lit(100), 12 * present(required) + 6 * present(optional) + 10 * present([doi_column]))


#: The styles, and below the texts of each: words, signs and field names as these formats have them.
CITATION_STYLES = ("apa7", "mla9", "chicago-author-date", "chicago-notes", "harvard", "ieee", "vancouver", "bibtex", "ris", "csl-json")


def citation(style: str, authors: Column, title: Column, year: Column, doi_column: Column, address: Column) -> Column:
    """Citation text of a publication by the name of a style; a DOI goes before an address, neither is an empty text."""
    who = F.coalesce(F.nullif(F.array_join(authors, ", "), F.lit("")), F.lit("Unknown author"))
    dated = F.coalesce(year.cast("string"), F.lit("n.d."))
    name = F.regexp_replace(title, r"\.+$", "")
    place = F.coalesce(F.concat(F.lit("https://doi.org/"), F.nullif(doi_column, F.lit(""))), address, F.lit(""))
    said = lambda *parts: F.trim(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    if style in ("apa7", "chicago-author-date", "harvard"):
        return said(who, " (", dated, "). ", name, ". ", place)
    if style in ("mla9", "chicago-notes"):
        return said(who, ". “", name, ".” ", dated, ". ", place)
    if style in ("ieee", "vancouver"):
        return said(who, ", “", name, ",” ", dated, ". ", place)
    if style == "bibtex":
        last = F.element_at(F.split(F.coalesce(F.get(authors, F.lit(0)), F.lit("Unknown")), r"\s+"), -1)
        key = F.regexp_replace(F.concat(last, dated), r"(?U)\W+", "")
        fields = [F.concat(F.lit(f"  {k} = {{"), v, F.lit("}")) for k, v in (("author", F.array_join(authors, " and ")), ("title", name), ("year", dated), ("url", place))]
        return F.concat(F.lit("@misc{"), key, F.lit(",\n"), F.concat_ws(",\n", *fields), F.lit("\n}"))
    if style == "ris":
        return F.concat(F.lit("TY  - GEN\n"), F.array_join(F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a)), "\n"), F.lit("\nTI  - "), name, F.lit("\nPY  - "), dated, F.lit("\nUR  - "), place, F.lit("\nER  -"))
    if style == "csl-json":
        item = F.struct(F.lit("article").alias("type"), name.alias("title"), F.transform(authors, lambda a: F.struct(a.alias("literal"))).alias("author"), F.struct(dated.alias("raw")).alias("issued"), doi_column.alias("DOI"), address.alias("URL"))
        return F.to_json(item, {"ignoreNullFields": "false"})
    raise ValueError(f"unknown style {style}")
