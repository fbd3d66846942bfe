"""Retrieval, keywords, summaries and chunks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import answers as A
from ..operators import ranking as W
from ..operators import retrieval as R
from ..operators.postings import may_meet
from ..sources.folders import folder
from .registry import SQL, query
from .views import heading, table


@query("j8_vector_topk", """SELECT query_id, id, similarity, rank::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity,
row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10""")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    found = R.nearest(e.where("vec_id % 50 = 0"), e, 10, id_col="vec_id", vector_col="embedding")
    return found.withColumn("similarity", F.round("similarity", 6))


_TERM_STOP = ", ".join(f"'{w}'" for w in R.TERM_STOP)
_TERMS = f"""CREATE_TERMS AS (SELECT ID, term, count(*) AS tf FROM (SELECT ID, unnest(list_filter(regexp_extract_all(lower(text), '{R.TERM}'), lambda w: w NOT IN ({_TERM_STOP}))) AS term FROM TABLE_) GROUP BY ID, term)"""
_D = _TERMS.replace("CREATE_TERMS", "d").replace("TABLE_", "documents").replace("ID", "doc_id")
_Q = _TERMS.replace("CREATE_TERMS", "q").replace("TABLE_", "benchmark").replace("ID", "item_id")


@query("r5_lexical_search", f"""WITH {_D}, {_Q}, dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM d GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(tf * tf)) AS qn FROM q GROUP BY 1),
p AS (SELECT item_id, doc_id, sum(d.tf * q.tf) AS p FROM d JOIN q USING (term) GROUP BY 1, 2)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT item_id, doc_id, round(p / (dn * qn), 6) AS score FROM p JOIN dn USING (doc_id) JOIN qn USING (item_id))) WHERE rank <= 10""")
def lexical_search(spark, sf):
    return R.lexical_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 10, doc_id="doc_id", query_id="item_id")


def _catalogue(spark, sf):
    """documents that have a vector, as publications (id, title, abstract, subjects, updated_at), and the vectors. The documents are written once; the texts of others aren't moved."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce(S.clean(heading(F.col("text"))), F.lit("")).alias("title"), S.clean(F.col("text")).alias("abstract"), F.array("lang", "source").alias("subjects"), F.timestamp_seconds(F.col("doc_id")).alias("updated_at"))
    ids = e.select("id").withColumn("_h", F.xxhash64("id"))
    may_meet(d.withColumn("_h", F.xxhash64("id")), ids, "_h").drop("_h").join(e.select("id").distinct(), "id").write.parquet(path := folder(spark, "catalogue"))
    d = spark.read.parquet(path)
    return d, e.join(d.select("id"), "id", "left_semi")


@query("r4_hybrid_search", r"""WITH d AS (SELECT doc_id AS id, coalesce(trim(regexp_replace(regexp_extract(text, '^[^.!?\n]*'), '[\s\x1c-\x1f]+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g')), '') AS abstract, lang, source, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id),
q AS (SELECT id AS query_id, e, trim(lower(array_to_string(string_split(title, ' ')[1:4], ' ')) || ' ' || lang) AS phrase FROM d WHERE id % 50 = 0),
w AS (SELECT *, list_filter(string_split(phrase, ' '), lambda x: length(x) > 2) AS words FROM q),
near AS (SELECT query_id, id, s FROM (SELECT query_id, id, list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(d.e, d.e)) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(d.e, d.e)) DESC, id) AS r FROM q JOIN d ON d.id <> query_id) WHERE r <= 50),
newest AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) AS r FROM w JOIN d ON len(words) = 0 OR len(list_filter(words, lambda x: contains(lower(title) || chr(10) || coalesce(lower(abstract), ''), x))) > 0) WHERE r <= 100),
c AS (SELECT query_id, id, max(s) AS semantic_score FROM (SELECT query_id, id, s FROM near UNION ALL SELECT query_id, id, 0.0 FROM newest) GROUP BY ALL),
x AS (SELECT c.query_id, c.id, semantic_score, CASE WHEN contains(lower(title), phrase) THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (len(list_filter(words, lambda y: contains(lower(title), y))) + 0.4::DOUBLE * len(list_filter(words, lambda y: contains(coalesce(lower(abstract), ''), y)))) / greatest(len(words), 1)) END AS lexical_score,
len(list_filter(words, lambda y: contains(lower(lang), y) OR contains(lower(source), y))) / greatest(len(words), 1)::DOUBLE AS keyword_score FROM c JOIN w USING (query_id) JOIN d ON d.id = c.id),
y AS (SELECT *, round(0.5::DOUBLE * semantic_score + 0.25::DOUBLE * lexical_score + 0.25::DOUBLE * keyword_score, 6) AS score FROM x)
SELECT query_id, id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM y) WHERE rank <= 10""".replace("\\\\", "\\"))
def hybrid_search(spark, sf):
    """The first words of every fiftieth document and its language are a query, its vector the query's."""
    pubs, vectors = _catalogue(spark, sf)
    chosen = pubs.where("id % 50 = 0")
    asked = chosen.select(F.col("id").alias("query_id"), F.concat_ws(" ", F.array_join(F.slice(F.split("title", " "), 1, 4), " "), F.get("subjects", F.lit(0))).alias("text"))
    near = R.nearest(vectors.where("id % 50 = 0"), vectors, 50, id_col="id", vector_col="embedding").select("query_id", "id", F.col("similarity").alias("score"))
    return R.hybrid(asked, pubs, near, 10).select("query_id", "id", "rank", "score")


_STOP = ", ".join(f"'{w}'" for w in R.STOP_WORDS)


@query("r6_keywords", f"""WITH w AS (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(concat_ws(' ', regexp_extract(text, '^[^.!?\n]*'), regexp_extract(text, '^[^.!?\n]*'), text, lang || ' ' || source)), '[a-z][a-z-]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS l FROM documents))
SELECT doc_id, term, round_even(n / most, 4) AS score FROM (SELECT doc_id, term, count(*) AS n, max(count(*)) OVER (PARTITION BY doc_id) AS most, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS r FROM w GROUP BY doc_id, term) WHERE r <= 10""")
def keywords(spark, sf):
    """Of whole texts; their beginning stands for a title and weighs twice more."""
    d = table(spark, sf, "documents").select("doc_id", heading(F.col("text")).alias("title"), F.col("text").alias("abstract"), F.array("lang", "source").alias("subjects"))
    return R.extracted_keywords(d, id_col="doc_id", title="title", abstract="abstract", subjects="subjects")


_PARTS = r"""WITH p AS (SELECT doc_id, text, list_filter([trim(x) FOR x IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))], lambda x: x <> '') AS s FROM documents) """.replace("\\\\", "\\")
_NONE = "'Abstract-only summary unavailable: Document ' || doc_id || ' has no abstract.'"


@query("r8_summary", _PARTS + f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN {_NONE} ELSE 'Abstract-based summary: ' || trim(left(array_to_string(s[1:2], ' '), 900)) END AS short,
CASE WHEN coalesce(text, '') = '' THEN {_NONE} ELSE 'Abstract-based summary: ' || trim(left(array_to_string(s[1:5], ' '), 900)) END AS detailed,
CASE WHEN coalesce(text, '') = '' THEN {_NONE} ELSE 'Background/objective: ' || s[1] || chr(10) || 'Evidence reported in abstract: ' || coalesce(nullif(array_to_string(s[2:5], ' '), ''), 'Not stated.') || chr(10) || 'Limitations: Not stated in the available abstract.' END AS structured FROM p""")
def summaries(spark, sf):
    name = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", *[R.summary(name, F.col("text"), k).alias(k) for k in ("short", "detailed", "structured")])


def _chunks(spark, sf):
    return R.chunked(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), "text"))


@query("r1_chunks")
def chunks(spark, sf):
    return _chunks(spark, sf).select("document_id", "page_start", "page_end", "chunk_index", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("characters"), S.tokens_by_characters(F.col("content")).alias("tokens"))


_SECTIONS = ", ".join(f"({k}, '{name}', [{', '.join(repr(w) for w in words)}])" for k, (name, words) in enumerate(R.SECTIONS.items()))


@query("r9_structured_summary", rf"""WITH d AS (SELECT doc_id AS document_id, text FROM documents WHERE trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g')) <> ''),
s AS (SELECT document_id, unnest(l) AS sentence, unnest(range(len(l))) AS si FROM (SELECT document_id, list_filter([trim(x) FOR x IN string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')], lambda x: length(x) BETWEEN 35 AND 600) AS l FROM d)),
n AS (SELECT *, trim(regexp_replace(lower(sentence), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g')) AS p FROM s),
u AS (SELECT document_id, p, min(si) AS si, arg_min(sentence, si) AS sentence FROM n WHERE len(string_split(p, ' ')) >= 7 GROUP BY ALL),
sec AS (SELECT * FROM (VALUES {_SECTIONS}) t(position, section, words)),
h AS (SELECT document_id, section, sentence, row_number() OVER (PARTITION BY document_id, section ORDER BY hits DESC, si) AS r FROM (SELECT *, len(list_filter(words, lambda w: contains(lower(sentence), w))) AS hits FROM u, sec) WHERE hits > 0),
o AS (SELECT document_id, section, string_agg(sentence || ' [p. 1]', ' ' ORDER BY r) AS sentences FROM h WHERE r <= 2 GROUP BY ALL)
SELECT document_id, section, position::INT AS position, coalesce(sentences, '{R.NOT_FOUND}') AS sentences, CASE WHEN sentences IS NULL THEN '' ELSE '1' END AS pages FROM (SELECT document_id FROM d) CROSS JOIN sec LEFT JOIN o USING (document_id, section)""".replace("\\\\", "\\"))
def structured_summary(spark, sf):
    """A document's text as its one page."""
    page = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_start"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    return R.structured_summary(page)


def _candidates(spark, sf, most: int):
    """The benchmark's texts as questions, with the nearest documents as ranked chunks of their sources."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.coalesce(S.clean(heading(F.col("text"))), F.lit("")).alias("title"), F.col("text").alias("content"))
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    found = R.lexical_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), most, doc_id="doc_id", query_id="item_id")
    ranked = found.select("item_id", F.col("doc_id").alias("chunk_id"), F.col("score").alias("similarity"), "rank")
    return ranked.join(b, "item_id").join(d, "chunk_id").withColumnRenamed("item_id", "query_id")


@query("r10_chunk_selection")
def chunk_selection(spark, sf):
    return A.selected_chunks(_candidates(spark, sf, 60))


@query("r11_assembled_evidence")
def assembled_evidence(spark, sf):
    """The chosen chunks, and beside them the five nearest publications that none of them is of."""
    c = _candidates(spark, sf, 60)
    chosen = A.selected_chunks(c).join(c, ["query_id", "chunk_id"]).select("query_id", F.col("document_id").alias("publication_id"), "chunk_id", "position")
    nearest = c.groupBy("query_id", F.col("document_id").alias("publication_id")).agg(F.min("rank").alias("position"))
    return A.assembled(chosen, nearest, 12).select("query_id", "publication_id", "chunk_id", "place", "source_type")


def _reranked(spark, sf):
    c = _candidates(spark, sf, 20)
    return A.reranked(c.select("query_id", "question", F.col("chunk_id").alias("id"), "document_id", F.col("chunk_id").alias("chunk_index"), "title", F.col("content").alias("text"), "similarity", "rank")), c


@query("r12_evidence")
def evidence(spark, sf):
    return _reranked(spark, sf)[0].select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query("r13_packed_context")
def packed_context(spark, sf):
    ranked, c = _reranked(spark, sf)
    none = F.lit(None).cast("string")
    sources = ranked.join(c.withColumnRenamed("chunk_id", "id"), ["query_id", "id"]).select(
        "query_id", "question", F.lit("Answer from the sources alone.").alias("system"), F.lit("").alias("history"), "id", "title", "document_id", none.alias("section"), F.lit(1).alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.col("content").alias("text"), "place"
    )
    return A.packed(sources).select("query_id", "id", "label", "tokens", "compressed", F.sha2("text", 256).alias("text_hash"))


@query("r15_answer_sentences")
def answer_sentences(spark, sf):
    ranked, c = _reranked(spark, sf)
    sources = ranked.join(c.withColumnRenamed("chunk_id", "id"), ["query_id", "id"]).select("query_id", "question", "place", "title", F.col("content").alias("text"))
    return A.answer_sentences(sources)


@query("w9_document_caps", "SELECT query_id, chunk_id FROM (SELECT l_suppkey AS query_id, l_orderkey AS chunk_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS d FROM lineitem) WHERE d <= CASE WHEN l_partkey % 2 = 0 THEN 3 ELSE 1 END) WHERE r <= 20")
def document_caps(spark, sf):
    """The best 20 of a supplier's lines, of an even part three at most, of an odd one."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    within = W.top(table(spark, sf, "lineitem").withColumn("even", F.col("l_partkey") % 2 == 0), ["l_suppkey", "l_partkey"], order, 3, rank="place").where(F.col("even") | (F.col("place") == 1))
    return W.top(within, ["l_suppkey"], order, 20).select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("chunk_id"))


@query("r14_history_window", """WITH r AS (SELECT conv_id, turn, greatest(1, CAST(round_even(length(coalesce(text, '')) / 4, 0) AS INT)) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
a AS (SELECT * FROM r WHERE r = 1), b AS (SELECT * FROM r WHERE r = 2), c AS (SELECT * FROM r WHERE r = 3), d AS (SELECT * FROM r WHERE r = 4),
s1 AS (SELECT conv_id, CASE WHEN n <= 500 THEN n ELSE 0 END AS s FROM a),
s2 AS (SELECT conv_id, s, CASE WHEN s + n <= 500 THEN s + n ELSE s END AS s2 FROM s1 JOIN b USING (conv_id)),
s3 AS (SELECT conv_id, s2, CASE WHEN s2 + n <= 500 THEN s2 + n ELSE s2 END AS s3 FROM s2 JOIN c USING (conv_id))
SELECT conv_id, turn FROM a WHERE n <= 500 UNION ALL SELECT conv_id, turn FROM b JOIN s1 USING (conv_id) WHERE s + n <= 500
UNION ALL SELECT conv_id, turn FROM c JOIN s2 USING (conv_id) WHERE s2 + n <= 500 UNION ALL SELECT conv_id, turn FROM d JOIN s3 USING (conv_id) WHERE s3 + n <= 500""")
def history_window(spark, sf):
    return R.history_window(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("r17_links", r"""SELECT page_id, position::INT AS position, link FROM (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS position FROM (SELECT page_id, regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']([^"''>\s]+)["'']', 1) AS l FROM pages))""")
def links(spark, sf):
    return R.page_links(table(spark, sf, "pages"))


@query("r19_ranking_quality", r"""WITH qd AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS run FROM documents),
h AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')[1:12] AS w FROM benchmark),
rel AS (SELECT DISTINCT item_id, doc_id FROM h JOIN qd ON len(w) = 12 AND contains(run, ' ' || array_to_string(w, ' ') || ' ')),
ranked AS (RANKED),
hit AS (SELECT item_id, count(*) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN rel USING (item_id, doc_id) GROUP BY 1),
n AS (SELECT item_id, count(*) AS n FROM rel GROUP BY 1),
e AS (SELECT n.item_id, coalesce(h / n, 0) AS r, coalesce(h / 10, 0) AS p, coalesce(1 / first, 0) AS m, coalesce(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 10) + 1)]), 0) AS g FROM n LEFT JOIN hit USING (item_id))
SELECT count(*) AS queries, round(avg(r), 6) AS recall, round(avg(p), 6) AS precision, round(avg(m), 6) AS mrr, round(avg(g), 6) AS ndcg FROM e""".replace("\\\\", "\\").replace("RANKED", SQL["r5_lexical_search"]))
def ranking_quality(spark, sf):
    """How often the search for a benchmark text finds the documents that hold its first twelve words."""
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    ranked = lexical_search(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), "rank")
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    heads = b.select(F.col("item_id").alias("query_id"), F.slice(words(F.col("text")), 1, 12).alias("h")).where(F.size("h") == 12).select("query_id", F.array_join("h", " ").alias("run"))
    runs = d.select(F.col("doc_id").alias("id"), words(F.col("text")).alias("w")).where(F.size("w") >= 12).select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 11), lambda i: F.array_join(F.slice("w", i, 12), " ")))).alias("run"))
    return R.ranking_quality(ranked, runs.join(F.broadcast(heads) if heads.count() < 100_000 else heads, "run").select("query_id", "id"))
