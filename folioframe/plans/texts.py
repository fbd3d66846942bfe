"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import query
from .views import table

_CLEAN = r"nullif(trim(regexp_replace({}, '[\s\x1c-\x1f]+', ' ', 'g')), '')"


def documents(spark, sf):
    return table(spark, sf, "documents")


@query("f1_whitespace", f"SELECT doc_id, sha256(coalesce({_CLEAN.format('text')}, '')) AS h FROM documents")
def whitespace(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(F.coalesce(S.clean(F.col("text")), F.lit("")), 256).alias("h"))


@query("f2_title", rf"SELECT doc_id, nullif(regexp_replace({_CLEAN.format('text')}, '[ /:]+$', ''), '') AS title FROM documents")
def titles(spark, sf):
    return documents(spark, sf).select("doc_id", S.title(F.col("text")).alias("title"))


@query("f3_author_name", "SELECT c_custkey, split_part(c_name, '#', 1) || ' ' || c_mktsegment AS author FROM customer")
def author_names(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.author_name(F.concat(F.col("c_mktsegment"), F.lit(",  "), F.substring_index("c_name", "#", 1))).alias("author"))


_DOI = "CASE o_orderkey % 3 WHEN 0 THEN 'https://doi.org/10.1234/ABC.' || o_orderkey WHEN 1 THEN 'doi 10.12/short' ELSE 'see 10.55555/x_(' || o_orderkey || ')z; end' END"


@query("f4_doi", rf"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '10.1234/abc.' || o_orderkey WHEN 2 THEN '10.55555/x_(' || o_orderkey || ')z' END AS doi FROM orders")
def dois(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.doi(F.expr(_DOI)).alias("doi"))


@query(
    "f5_orcid",
    """WITH d AS (SELECT c_custkey, lpad((c_custkey * 7919 % 1000000000000000)::VARCHAR, 15, '0') AS b FROM customer),
t AS (SELECT c_custkey, b, list_reduce([0] || [CAST(x AS INT) FOR x IN regexp_extract_all(b, '.')], lambda a, x: ((a + x) * 2) % 11) AS s FROM d)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN substr(b, 1, 4) || '-' || substr(b, 5, 4) || '-' || substr(b, 9, 4) || '-' || substr(b, 13, 3) || CASE (12 - s) % 11 WHEN 10 THEN 'X' ELSE ((12 - s) % 11)::VARCHAR END END AS orcid FROM t""",
)
def orcids(spark, sf):
    """Every other identifier carries the wrong check sign."""
    c = table(spark, sf, "customer").withColumn("b", F.lpad((F.col("c_custkey") * 7919 % 1000000000000000).cast("string"), 15, "0"))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substr(F.col("b"), i, F.lit(1)).cast("int")), F.lit(0).cast("long"), lambda a, d: (a + d) * 2)
    check = (12 - total % 11) % 11 + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1)
    sign = F.when(check % 11 == 10, "X").otherwise((check % 11).cast("string"))
    b = F.col("b")
    text = F.concat(F.lit("orcid:"), F.substring(b, 1, 4), F.lit("-"), F.substring(b, 5, 4), F.lit("-"), F.substring(b, 9, 4), F.lit("-"), F.substring(b, 13, 3), sign)
    return c.select("c_custkey", S.orcid(text).alias("orcid"))


@query("f7_issn", "SELECT p_partkey, lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '-' || lpad((p_size * 7)::VARCHAR, 3, '0') || 'X' AS issn FROM part")
def issns(spark, sf):
    text = F.concat(F.lit("ISSN "), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("p_size") * 7).cast("string"), 3, "0"), F.lit("x"))
    return table(spark, sf, "part").select("p_partkey", S.issn(text).alias("issn"))


_NAMES = list(S.LANGUAGES)


@query("f8_language", "SELECT o_orderkey, ['en', 'en', 'en', 'am', 'am', 'am', 'om', 'om', 'om', 'aa', 'aa', 'ti', 'ti', 'ti', 'fr-ca', NULL][o_orderkey % 16 + 1] AS language FROM orders")
def languages(spark, sf):
    """Every name and code, in other letters and with blanks, and some that aren't known."""
    raw = F.get(F.array(*[F.lit(f" {n.title()} ") for n in _NAMES], F.lit("FR-ca"), F.lit("  ")), (F.col("o_orderkey") % 16).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", S.language(raw).alias("language"))


@query("f9_url", r"SELECT page_id, lower(regexp_extract(url, '^[^:]+://[^/?#]+')) || regexp_replace(regexp_replace(url, '^[^:]+://[^/?#]+', ''), '#.*$', '') AS url FROM pages")
def urls(spark, sf):
    """Parameters put behind the path of every third address go again."""
    given = F.when((F.col("page_id") % 3 == 0) & F.col("url").rlike("://[^/?#]+/"), F.regexp_replace("url", r"^([^?#]*)", "$1;session=4")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", S.url(given).alias("url"))


@query("f10_date", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE WHEN 2 THEN date_trunc('year', o_orderdate)::DATE END::VARCHAR AS day FROM orders""")
def dates(spark, sf):
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 2 THEN date_format(o_orderdate, 'yyyy') || ' or so' ELSE 'no date' END")
    return table(spark, sf, "orders").select("o_orderkey", S.date(raw).cast("string").alias("day"))


@query("f11_year", "SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders")
def years(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.year(F.concat(F.lit("c. 1234567, printed "), F.year("o_orderdate").cast("string"), F.lit("; 2099x"))).alias("y"))


@query("f12_terms", "SELECT p_partkey, p_brand || '|' || p_type AS terms FROM part")
def term_lists(spark, sf):
    raw = F.concat(F.col("p_brand"), F.lit("; "), F.col("p_type"), F.lit(" , "), F.upper("p_brand"), F.lit(";;"), F.lower("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.terms(raw), "|").alias("terms"))


@query("f13_tolerant_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 1, 2, 3, 4) THEN o_orderdate::DATE WHEN o_orderkey % 9 IN (5, 6) THEN date_trunc('month', o_orderdate)::DATE WHEN o_orderkey % 9 = 7 THEN date_trunc('year', o_orderdate)::DATE END::VARCHAR AS day FROM orders""")
def tolerant_dates(spark, sf):
    """Each form, the repaired ones and one out of range, by turns."""
    raw = F.expr("""CASE o_orderkey % 9 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'AAU' WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 2 THEN date_format(o_orderdate, 'M/d/yy') WHEN 3 THEN '0' || date_format(o_orderdate, 'yyyy-MM-dd')
        WHEN 4 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'T23:30:00+03:00' WHEN 5 THEN date_format(o_orderdate, 'MMMM, yyyy') WHEN 6 THEN upper(date_format(o_orderdate, 'MMM yyyy')) WHEN 7 THEN date_format(o_orderdate, ' yyyy ') ELSE '0001-01-01' END""")
    return table(spark, sf, "orders").select("o_orderkey", S.tolerant_date(raw).cast("string").alias("day"))


@query("f16_identity_title", r"SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '[\s\x1c-\x1f]+', ' ', 'g')), '') AS key FROM documents")
def identity_titles(spark, sf):
    return documents(spark, sf).select("doc_id", S.identity_title(F.col("text")).alias("key"))


@query("f27_mojibake", "SELECT doc_id, sha256(replace(coalesce(text, ''), 'Â', '') || CASE doc_id % 3 WHEN 0 THEN ' it''s ' WHEN 1 THEN ' \"so' ELSE ' x' END) AS h FROM documents")
def repaired(spark, sf):
    spoilt = F.when(F.col("doc_id") % 3 == 0, " itâ€™s ").when(F.col("doc_id") % 3 == 1, "Â â€œso").otherwise(" Âx")
    return documents(spark, sf).select("doc_id", F.sha2(S.repaired(F.concat(F.coalesce("text", F.lit("")), spoilt)), 256).alias("h"))


@query("f28_lines", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS h FROM documents")
def cleaned_lines(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(S.clean_lines(F.col("text")), 256).alias("h"))


@query("f31_markup", rf"SELECT page_id, length({_CLEAN.format(chr(39).join(['regexp_replace(html, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))})::INT AS n FROM pages")
def markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(S.without_markup(F.col("html"))).alias("n"))


@query("f34_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def hashes(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))


@query("f35_token_estimates", r"""SELECT doc_id, greatest(1, len(regexp_extract_all(t, '\w+|[^\w\s]')), CAST(ceil(strlen(t) / 3.0) AS INT))::INT AS by_bytes,
greatest(1, CAST(round_even(len(regexp_extract_all(t, '\S+')) * 1.3, 0) AS INT)) AS by_words, greatest(1, CAST(round_even(length(t) / 4, 0) AS INT)) AS by_characters
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def token_estimates(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return documents(spark, sf).select("doc_id", S.tokens_by_bytes(t).alias("by_bytes"), S.tokens_by_words(t).alias("by_words"), S.tokens_by_characters(t).alias("by_characters"))


@query("f36_sentences", r"SELECT doc_id, len(list_filter([trim(x) FOR x IN string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')], lambda x: x <> ''))::INT AS n FROM documents")
def sentence_counts(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(S.sentences(F.col("text"))).alias("n"))


@query("f40_grade", "SELECT o_orderkey, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT o_orderkey, o_totalprice % 100 AS s FROM orders)")
def grades(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.grade(F.col("o_totalprice") % 100).alias("grade"))


@query("f43_cosine", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosines(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(other, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


_STYLED = """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE [c_name, 'Bo Lemma'] END AS a, 'On ' || o_orderpriority AS t, CASE WHEN o_orderkey % 7 = 0 THEN 'n.d.' ELSE year(o_orderdate)::VARCHAR END AS y,
CASE WHEN o_orderkey % 3 = 0 THEN 'https://doi.org/10.1/' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'https://x.org/' || o_orderkey ELSE '' END AS l FROM orders JOIN customer ON o_custkey = c_custkey),
q AS (SELECT *, CASE WHEN len(a) = 0 THEN 'Unknown author' ELSE array_to_string(a, ', ') END AS w FROM p) """


@query(
    "f45_citation",
    _STYLED
    + """SELECT o_orderkey, trim(w || ' (' || y || '). ' || t || '. ' || l) AS apa7, trim(w || '. “' || t || '.” ' || y || '. ' || l) AS mla9, trim(w || ', “' || t || ',” ' || y || '. ' || l) AS ieee,
'@misc{' || CASE WHEN len(a) = 0 THEN 'Unknown' ELSE regexp_replace(a[1], '\\W+', '', 'g') END || regexp_replace(y, '\\W+', '', 'g') || ',' || chr(10) || '  author = {' || array_to_string(a, ' and ') || '},' || chr(10) || '  title = {' || t || '},' || chr(10) || '  year = {' || y || '},' || chr(10) || '  url = {' || l || '}' || chr(10) || '}' AS bibtex,
'TY  - GEN' || chr(10) || array_to_string([('AU  - ' || x) FOR x IN a], chr(10)) || chr(10) || 'TI  - ' || t || chr(10) || 'PY  - ' || y || chr(10) || 'UR  - ' || l || chr(10) || 'ER  -' AS ris FROM q""".replace("\\\\", "\\"),
)
def citations(spark, sf):
    o, k = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")), F.col("o_orderkey")
    who = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("c_name", F.lit("Bo Lemma")))
    doi = F.when(k % 3 == 0, F.concat(F.lit("10.1/"), k.cast("string")))
    address = F.when(k % 3 != 2, F.concat(F.lit("https://x.org/"), k.cast("string")))
    year = F.when(k % 7 != 0, F.year("o_orderdate"))
    return o.select(k, *[S.citation(s, who, F.concat(F.lit("On "), F.col("o_orderpriority"), F.lit(".")), year, doi, address).alias(s) for s in ("apa7", "mla9", "ieee", "bibtex", "ris")])


@query("f48_issue_type", r"SELECT event_id, left(regexp_replace(regexp_replace(lower(event_type || ' Kind-1'), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) AS kind FROM events")
def issue_types(spark, sf):
    return table(spark, sf, "events").select("event_id", S.issue_type(F.concat(F.col("event_type"), F.lit(" Kind-1: and more"))).alias("kind"))


@query("f50_page_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'Page ' || l_linenumber ELSE 'Pages ' || l_linenumber || '-' || (l_linenumber + 2) END AS label FROM lineitem")
def page_labels(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.page_label(n, F.when(n % 3 != 0, n + 2)).alias("label"))
