"""Fields, resolutions and orders over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import scalars as S
from ..operators import identity as D
from ..sources import canonical as C
from ..sources import records as R
from .registry import query
from .views import PUBLICATIONS, publications, table


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("k", F.col("o_orderkey").cast("string"))


@query("f6_orcid_unchecked", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '0000-0002-1825-' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || 'X' END AS orcid FROM orders")
def orcid_unchecked(spark, sf):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://orcid.org/0000-0002-1825-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit("x"))).otherwise("0000-0002-1825")
    return _orders(spark, sf).select("o_orderkey", S.orcid(text, False).alias("orcid"))


@query("f14_run_time", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(o_orderdate) WHEN 2 THEN epoch_us(o_orderdate) - 3 * 3600000000 ELSE epoch_us(TIMESTAMP '2024-07-16 00:00:00') END AS us FROM orders")
def run_times(spark, sf):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k % 4 == 0, F.concat(day, F.lit("Z"))).when(k % 4 == 1, day).when(k % 4 == 2, F.concat(day, F.lit("+03:00"))).when(k % 8 == 3, "not a time")
    return _orders(spark, sf).select("o_orderkey", F.unix_micros(X.run_time(raw, F.lit("2024-07-16T00:00:00Z").cast("timestamp"))).alias("us"))


@query("f15_identity_text", r"SELECT doc_id, nullif(trim(regexp_replace(lower(text), '[\s\x1c-\x1f]+', ' ', 'g')), '') AS key FROM documents")
def identity_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.identity(F.col("text")).alias("key"))


@query("f17_publisher", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Addis Ababa University' WHEN 1 THEN 'Press ' || c_custkey ELSE left(repeat('Soil ', 60), 255) END AS publisher FROM customer")
def publishers(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, " AAU ").when(k % 3 == 1, F.concat(F.lit("Press  "), k.cast("string"))).otherwise(F.repeat(F.lit("Soil "), 60))
    return table(spark, sf, "customer").select(k, C.publisher(raw).alias("publisher"))


@query("f19_bounded_title", r"SELECT doc_id, CASE WHEN length(t) <= 1000 THEN t END AS title FROM (SELECT doc_id, nullif(trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g')), '') AS t FROM documents)")
def bounded_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.bounded_title(F.col("text")).alias("title"))


@query("f20_first_value", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS value, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN DATE '2001-01-01' END::VARCHAR AS day FROM orders")
def first_values(spark, sf):
    k = F.col("o_orderkey")
    value = S.first_value(F.when(k % 3 == 0, " A ").otherwise("  "), F.when(k % 3 == 1, F.col("o_orderpriority")))
    day = X.first_date(F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("undated"), F.when(k % 3 == 1, "2001, spring"))
    return _orders(spark, sf).select(k, value.alias("value"), day.cast("string").alias("day"))


@query("f21_affiliations", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'Dept' END, 'Fund'], lambda x: x IS NOT NULL), '|') AS affiliations FROM customer")
def affiliations(spark, sf):
    k = F.col("c_custkey")
    some = X.listed(F.when(k % 2 == 0, F.array("c_mktsegment")), F.when(k % 3 == 0, F.array(F.lit("Dept"), F.lit(""))), F.array(F.lit("Fund"), F.lit(None)))
    return table(spark, sf, "customer").select(k, F.array_join(some, "|").alias("affiliations"))


@query("f23_source_urls", "SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '|' || url || '.pdf' ELSE '' END || '|http://x.org/' || page_id AS urls FROM pages WHERE url LIKE 'http%'")
def source_addresses(spark, sf):
    k = F.col("page_id")
    urls = X.source_urls(F.col("url"), F.when(k % 2 == 0, F.concat("url", F.lit(".pdf"))), F.array(F.col("url"), F.lit("doi:10.1/x"), F.concat(F.lit("http://x.org/"), k.cast("string"))))
    return table(spark, sf, "pages").where("url like 'http%'").select(k, F.array_join(urls, "|").alias("urls"))


@query("f24_managed_handle", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'https://other.org/x' ELSE 'https://repo.org/handle/123/' || o_orderkey END AS address FROM orders")
def managed_handles(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("http://hdl.handle.net/123/"), F.col("k"))).when(k % 3 == 1, F.concat(F.lit("https://old.org/handle/123/"), F.col("k"), F.lit("?x=1"))).otherwise("https://other.org/x")
    return _orders(spark, sf).select("o_orderkey", X.managed_handle(raw, "https://repo.org/").alias("address"))


@query("f25_file_type", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' WHEN 3 THEN '.docx' WHEN 4 THEN '.pdf' END AS kind FROM orders")
def file_types(spark, sf):
    k = F.col("o_orderkey") % 6
    mime = F.when(k == 0, "Application/PDF; charset=x").otherwise("text/html")
    head = F.unhex(F.when(k == 1, "504B030414").when(k == 2, "D0CF11E0A1B11AE1").otherwise("00"))
    return _orders(spark, sf).select("o_orderkey", X.file_type(mime, head, F.when(k == 3, "My.File.DOCX"), F.when(k == 4, "https://a.org/b/c%20d.PDF?x=1").otherwise("https://a.org/b.html")).alias("kind"))


@query("f26_file_name", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a_b_ _' || o_orderkey WHEN 1 THEN 'document' ELSE repeat('x', 140) END AS name, 'my file ' || o_orderkey || '.PDF' AS url_name, '.pdf' AS ending FROM orders")
def file_names(spark, sf):
    k, url = F.col("o_orderkey"), F.concat(F.lit("https://a.org/x/my%20file%20"), F.col("k"), F.lit(".PDF?y=/z"))
    raw = F.when(k % 3 == 0, F.concat(F.lit(' a/b? \t'), F.col("k"), F.lit(" ."))).when(k % 3 == 1, " . ").otherwise(F.repeat(F.lit("x"), 200))
    return _orders(spark, sf).select(k, X.safe_name(raw).alias("name"), X.url_name(url).alias("url_name"), X.extension(X.url_name(url)).alias("ending"))


@query("f29_page_text", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace('exam-' || chr(10) || 'ple ' || text, '(\w)-\n(\w)', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS h FROM documents")
def page_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.clean_pages(F.concat(F.lit("exam-\nple\x00"), "text")), 256).alias("h"))


@query("f30_document_title", "SELECT o_orderkey, 'My report ' || o_orderkey AS title FROM orders")
def document_titles(spark, sf):
    k = F.col("o_orderkey")
    lead = F.when(k % 2 == 0, "12_").otherwise("0b5d9a1e-1111-4222-8333-444455556666_")
    return _orders(spark, sf).select(k, S.document_title(F.concat(F.lit("/a/b/"), lead, F.lit("My_report-"), F.col("k"), F.lit(".pdf"))).alias("title"))


@query("f32_labelled_text", "SELECT o_orderkey, 'Title:' || chr(10) || 'On ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || 'Abstract:' || chr(10) || 'Soil & water' ELSE '' END || chr(10) || chr(10) || 'Keywords:' || chr(10) || 'soil; crop' || chr(10) || chr(10) || 'Publication Year:' || chr(10) || year(o_orderdate) AS t FROM orders")
def labelled_texts(spark, sf):
    k = F.col("o_orderkey")
    text = X.labelled_text({"Title": F.array(F.concat(F.lit("On <b>"), F.col("o_orderpriority"), F.lit("</b>"))), "Abstract": F.array(F.when(k % 2 == 0, "Soil  & water").otherwise(F.concat(F.lit("on "), F.lower("o_orderpriority")))), "Keywords": F.array(F.lit("soil"), F.lit("Soil"), F.lit("crop")), "Subjects": F.array(F.lit("CROP")), "Publication Year": F.array(F.year("o_orderdate").cast("string"))})
    return _orders(spark, sf).select(k, text.alias("t"))


_SEARCH = ", ".join(f"'{w}'" for w in S.SEARCH_STOP)
_ANSWER = ", ".join(f"'{w}'" for w in S.ANSWER_STOP)


@query("f37_token_lists", rf"""SELECT conv_id, turn, array_to_string(list_filter([regexp_replace(regexp_replace(w, '^[.,?!:;()\[\]{{}}"'']+', ''), '[.,?!:;()\[\]{{}}"'']+$', '') FOR w IN regexp_split_to_array(lower(text), '[\s]+')], lambda w: w <> '' AND w NOT IN ({_SEARCH})), ' ') AS search,
array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'), lambda w: w NOT IN ({_ANSWER})), ' ') AS answer, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{3,}}'))::INT AS terms FROM conversations""")
def token_lists(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(S.search_tokens(t), " ").alias("search"), F.array_join(S.answer_tokens(t), " ").alias("answer"), F.size(S.context_terms(t)).alias("terms"))


@query("f39_first_pass_score", "SELECT o_orderkey, least(100, 12 * (2 + (o_orderkey % 2 = 0)::INT) + 6 * (o_orderkey % 3 = 0)::INT + 10 * (o_orderkey % 5 = 0)::INT)::INT AS score FROM orders")
def first_pass_scores(spark, sf):
    k, some = F.col("o_orderkey"), F.lit("x")
    return _orders(spark, sf).select(k, S.first_pass_score([some, some, F.when(k % 2 == 0, "x")], [F.when(k % 3 == 0, "x")], F.when(k % 5 == 0, "10.1/x")).alias("score"))


@query("f41_bounded_score", "SELECT o_orderkey, least(greatest(round(o_totalprice / 1000 - 50, 2), 0), 100)::DOUBLE AS score FROM orders")
def bounded_scores(spark, sf):
    return _orders(spark, sf).select("o_orderkey", S.bounded(F.col("o_totalprice") / 1000 - 50).alias("score"))


@query("f49_import_key", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'e' || o_orderkey WHEN 1 THEN 'u' || o_orderkey WHEN 2 THEN '1/' || o_orderkey END AS key FROM orders")
def import_keys(spark, sf):
    k, n = F.col("o_orderkey") % 4, F.col("k")
    some = lambda at, lead: F.when(k == at, F.concat(F.lit(lead), n, F.lit(" "))).otherwise(" ")
    return _orders(spark, sf).select("o_orderkey", X.import_key(some(0, " e"), some(1, "u"), some(2, "1/")).alias("key"))


@query("t2_default_order", PUBLICATIONS + "SELECT publication_id FROM (SELECT publication_id, CASE WHEN publication_id % 3 = 0 THEN updated_at END AS u, updated_at AS c FROM publications) ORDER BY coalesce(u, c) DESC, publication_id LIMIT 200")
def default_order(spark, sf):
    """By the last update, else the creation."""
    p = publications(spark, sf).select("publication_id", F.when(F.col("publication_id") % 3 == 0, F.col("updated_at")).alias("u"), F.col("updated_at").alias("c"))
    return p.orderBy(F.desc(F.coalesce("u", "c")), "publication_id").limit(200).select("publication_id")


@query("t6_documents_by_extraction", "SELECT doc_id FROM documents ORDER BY CASE WHEN doc_id % 4 <> 0 THEN n_chars END DESC NULLS LAST, lang, doc_id LIMIT 100")
def documents_by_extraction(spark, sf):
    at = F.when(F.col("doc_id") % 4 != 0, F.col("n_chars"))
    return table(spark, sf, "documents").orderBy(at.desc_nulls_last(), "lang", "doc_id").limit(100).select("doc_id")


_PAIRS = PUBLICATIONS + ", d AS (SELECT a.publication_id AS first_id, b.publication_id AS second_id, round(1 - abs(a.quality_score - b.quality_score) / 100, 4) AS score FROM publications a JOIN publications b ON a.doi = b.doi AND a.publication_id < b.publication_id WHERE a.quality_score IS NOT NULL AND b.quality_score IS NOT NULL) "


def _scored_pairs(spark, sf):
    p = publications(spark, sf).where("doi is not null and quality_score is not null").select("publication_id", "doi", "quality_score")
    a, b = (p.select(F.col("publication_id").alias(f"{n}_id"), "doi", F.col("quality_score").alias(n)) for n in ("first", "second"))
    return a.join(b, "doi").where("first_id < second_id").select("first_id", "second_id", F.round(1 - F.abs(F.col("first") - F.col("second")) / 100, 4).alias("score"))


@query("t9_duplicate_list", _PAIRS + "SELECT first_id, second_id FROM d ORDER BY score DESC, first_id, second_id LIMIT 200")
def duplicate_list(spark, sf):
    return _scored_pairs(spark, sf).orderBy(F.desc("score"), "first_id", "second_id").limit(200).select("first_id", "second_id")


@query("d8_duplicate_review", _PAIRS + "SELECT first_id, second_id, CASE WHEN first_id % 2 = 0 THEN 'confirmed' ELSE 'pending' END AS status, first_id % 2 = 0 AS reviewed FROM d")
def duplicate_review(spark, sf):
    """Reviews set a pair's status and time; pairs without one stay pending."""
    pairs = _scored_pairs(spark, sf).select("first_id", "second_id")
    reviews = pairs.where("first_id % 2 = 0").select("first_id", "second_id", F.lit("confirmed").alias("s"), F.lit("2024-07-16").cast("timestamp").alias("at"))
    both = pairs.join(reviews, ["first_id", "second_id"], "left")
    return both.select("first_id", "second_id", F.coalesce("s", F.lit("pending")).alias("status"), F.col("at").isNotNull().alias("reviewed"))


@query("d12_vocabulary", "SELECT p_partkey, left(sha256(lower(p_type)), 32) AS type_id FROM part")
def vocabulary(spark, sf):
    """Types by their folded name; one that isn't known gets an entry."""
    none = table(spark, sf, "part").limit(0).select(F.lit("x").alias("type_id"), F.lit("y").alias("normalized_name"))
    return D.resolved(table(spark, sf, "part").select("p_partkey", "p_type"), none, [S.identity(F.col("p_type"))], ["normalized_name"], "type_id").select("p_partkey", "type_id")


@query("d13_university_and_repository", """SELECT o_orderkey, coalesce(n_nationkey::VARCHAR, left(sha256('AUTO-SRC' || o_orderkey % 30), 32)) AS university_id, n_nationkey IS NULL AS university_is_new,
CASE WHEN n_nationkey IS NOT NULL AND o_orderkey % 2 = 0 THEN 'repo' || n_nationkey WHEN n_nationkey IS NOT NULL THEN 'repo' || n_nationkey ELSE left(sha256('https://r.org/' || o_orderkey % 30), 32) END AS repository_id FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 30""")
def university_and_repository(spark, sf):
    """By code (else AUTO and the source), then the repository by university and folded name, else by address."""
    k = F.col("o_orderkey") % 30
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("university_id"), F.concat(F.lit("AUTO-SRC"), F.col("n_nationkey").cast("string")).alias("code"))
    code = F.upper(F.left(F.concat(F.lit("AUTO-src"), k.cast("string")), F.lit(40)))
    u = D.resolved(_orders(spark, sf).select("o_orderkey"), n, [code], ["code"], "university_id").withColumnRenamed("_new", "university_is_new")
    known = n.select(F.concat(F.lit("repo"), "university_id").alias("repository_id"), F.concat("university_id", F.lit("|main library")).alias("by_name"), F.concat(F.lit("https://r.org/"), "university_id").alias("base_url"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat("university_id", F.lit("|"), S.identity(F.lit(" Main  Library ")))).otherwise(F.concat("university_id", F.lit("|other")))
    return D.resolved(u, known, [name, F.concat(F.lit("https://r.org/"), k.cast("string"))], ["by_name", "base_url"], "repository_id").select("o_orderkey", "university_id", "university_is_new", "repository_id")


@query("k6_document_upsert", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE source END AS title, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN 'updated' ELSE 'kept' END AS action FROM documents")
def document_upsert(spark, sf):
    """On a document's path; all columns are overwritten, by nulls too."""
    d, k = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "lang"), F.col("doc_id")
    return D.upserted(d, d.where(k % 2 == 0).select(k, F.lit("new").alias("title"), F.when(k % 3 != 0, F.col("lang")).alias("lang")), "doc_id", ["title", "lang"])


@query("st6_stale_embeddings", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'stale' END AS why FROM documents WHERE doc_id % 3 = 0 OR doc_id % 3 <> 0 AND doc_id % 5 = 0")
def stale_embeddings(spark, sf):
    """What a refresh has to encode: no vector, or one of another text, by the hash of the text."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    stored = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("h")).alias("was"))
    both = d.join(stored, "doc_id", "left").where(F.col("was").isNull() | (F.col("was") != F.col("h")))
    return both.select("doc_id", F.when(F.col("was").isNull(), "missing").otherwise("stale").alias("why"))


@query("s18_anchors", r"""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"''>]+)["''][^>]*>(.*?)</a>', 1)) AS href FROM pages) GROUP BY 1""")
def anchors(spark, sf):
    """Anchors with address and text."""
    pattern = F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"'>]+)["'][^>]*>(.*?)</a>""")
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("text"))
    each = table(spark, sf, "pages").select("page_id", F.explode(pairs).alias("a")).select("page_id", "a.href", X.without_markup(F.col("a.text")).alias("text"))
    return each.groupBy("page_id").agg(F.count("href").alias("n"))


@query("n3_etd_records", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id ELSE 'h/' || doc_id END AS external_id, 'T ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'Report' ELSE 'Thesis' END AS publication_type,
CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 2020 END AS publication_year, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id ELSE 'h/' || doc_id END AS repository_identifier, doc_id % 7 = 0 AS is_deleted, 'Ada|Bo' AS authors FROM documents""")
def etd_records(spark, sf):
    """JSON arrays of theses, ten documents a file; what is no object is skipped."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    row = F.to_json(F.struct(k, F.when(k % 3 == 0, F.concat(F.lit("u"), n)).alias("uuid"), F.when(k % 3 != 0, F.concat(F.lit("h/"), n)).alias("handle"), F.concat(F.lit(" T  "), n, F.lit(" :")).alias("title"), F.when(k % 5 != 0, "2020-05-01").alias("publication_date"), F.array(F.lit("Ada"), F.lit("ada"), F.lit(" "), F.lit("Bo")).alias("authors"), F.when(k % 2 == 0, F.array(F.lit(" "), F.lit("Report"))).alias("document_types"), (k % 7 == 0).alias("withdrawn")))
    files = table(spark, sf, "documents").groupBy(F.floor(k / 10).alias("file")).agg(F.concat(F.lit("[7, "), F.array_join(F.collect_list(row), ", "), F.lit("]")).alias("content"))
    return C.etd(R.import_rows(files).where("error is null")).select("doc_id", "external_id", "title", "publication_type", "publication_year", "repository_identifier", "is_deleted", F.array_join("authors", "|").alias("authors"))
