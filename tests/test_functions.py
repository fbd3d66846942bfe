"""Scalar cases and record scans."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from folioframe.functions import scalars as S
from folioframe.operators import identity as D
from folioframe.operators import quality as Q
from folioframe.operators import reports as P
from folioframe.operators import retrieval as R
from folioframe.sources import records as X


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first().x


def test_scalars(spark):
    assert one(spark, S.clean, " a \t b\x1f") == "a b" and one(spark, S.clean, "  ") is None
    assert one(spark, S.title, "Soil fertility : /") == "Soil fertility"
    assert one(spark, S.author_name, "Bekele,  Aster, T.") == "Aster, T. Bekele"
    assert one(spark, S.doi, "https://doi.org/10.1234/RHE.2025.001.") == "10.1234/rhe.2025.001" and one(spark, S.doi, "10.12/x") is None
    assert one(spark, S.orcid, "https://orcid.org/0000-0002-1825-0097") == "0000-0002-1825-0097" and one(spark, S.orcid, "0000-0002-1825-0098") is None
    assert one(spark, S.language, " Amharic ") == "am" and one(spark, S.language, "xx") == "xx"
    assert one(spark, S.url, "HTTP://Ex.ORG/A?b=1#c") == "http://ex.org/A?b=1" and one(spark, S.url, "no url") is None
    assert str(one(spark, S.date, "2023-07")) == "2023-07-01" and str(one(spark, S.date, "2023 spring")) == "2023-01-01" and one(spark, S.date, "2023-02-31") is None
    assert one(spark, S.terms, "Health; soil, health ;") == ["Health", "soil"]
    assert one(spark, S.sentences, "One. Two!\nThree") == ["One.", "Two!", "Three"]
    assert one(spark, S.repaired, "itâ€™s â€œsoâ€ – Â it") == "it's \"so\" –  it"
    assert [one(spark, S.language, x) for x in ("tir", "Tigrinya", "Afaan Oromo", "eng")] == ["ti", "ti", "afaan oromo", "en"]
    assert one(spark, S.clean_pages, "exam-\nple  x\n\n\n\ny") == "example x\n\ny"
    assert one(spark, S.document_title, "/a/12_My_report-one.pdf") == "My report one"
    assert abs(S.weights({"completeness": 1.3}, Q.WEIGHTS)["completeness"] - 0.65) < 1e-9 and S.weights({"timeliness": -1}, Q.WEIGHTS)["timeliness"] == 0.0 and S.weights(dict.fromkeys(Q.WEIGHTS, 0), Q.WEIGHTS) == S.weights(None, Q.WEIGHTS) and abs(sum(S.weights({"completeness": -1}, Q.WEIGHTS).values()) - 1) < 1e-9


def test_citations(spark):
    def text(style, authors=("Abel Kebede", "Sara Ali"), title="Soil health.", year=2020, doi="10.1/x", url="https://a.org"):
        row = spark.createDataFrame([(list(authors), title, year, doi, url)], "a array<string>, t string, y int, d string, u string")
        return row.select(S.citation(style, *map(F.col, "atydu")).alias("x")).first().x

    assert text("apa7") == text("harvard") == text("chicago-author-date") == "Abel Kebede, Sara Ali (2020). Soil health. https://doi.org/10.1/x"
    assert text("mla9", doi=None) == text("chicago-notes", doi=None) == "Abel Kebede, Sara Ali. “Soil health.” 2020. https://a.org"
    assert text("ieee", authors=(), year=None, doi=None, url=None) == text("vancouver", authors=(), year=None, doi=None, url=None) == "Unknown author, “Soil health,” n.d.."
    assert text("bibtex") == "@misc{Kebede2020,\n  author = {Abel Kebede and Sara Ali},\n  title = {Soil health},\n  year = {2020},\n  url = {https://doi.org/10.1/x}\n}"
    assert text("ris") == "TY  - GEN\nAU  - Abel Kebede\nAU  - Sara Ali\nTI  - Soil health\nPY  - 2020\nUR  - https://doi.org/10.1/x\nER  -"
    assert json.loads(text("csl-json")) == {"type": "article", "title": "Soil health", "author": [{"literal": "Abel Kebede"}, {"literal": "Sara Ali"}], "issued": {"raw": "2020"}, "DOI": "10.1/x", "URL": "https://a.org"}
    assert all(text(s) for s in S.CITATION_STYLES)
    with pytest.raises(ValueError):
        text("apa")


RECORD = "publication_id int, title string, abstract string, authors array<string>, keywords array<string>, subjects array<string>, publication_year int, publication_date date, doi string, orcids array<string>, language string, source string, source_type string, external_id string, repository_identifier string, raw_record string, publisher string, journal string, article_url string, pdf_url string, source_urls array<string>, license_name string, license_url string, license string, harvested_at timestamp, repository_datestamp timestamp, is_deleted boolean"


def test_quality(spark):
    day = datetime.datetime(2024, 5, 1)
    good = (1, "Soil fertility in highlands", "A study of soil fertility in highland farms.", ["Abel Kebede", "Sara Ali"], ["soil", "farms"], ["Agronomy"], 2024, datetime.date(2024, 3, 1), "10.1234/abc.1", ["0000-0002-1825-0097"], "en", "s", "oai_pmh", "x1", "r1", "{}", "Jimma Press", "Annals", "https://a.org/1", "https://a.org/1.pdf", [], "CC BY 4.0", None, None, day, day, False)
    poor = (2, "N/A", "short", [], ["  Health  ", "Health"], [], 3020, None, "bad-doi", [], "english", "s", "oai_pmh", None, "r2", "{}", "", "", "ftp://a.org", "https://b.org/x.pdf", [], None, None, None, datetime.datetime(2022, 1, 1), day, True)
    none = (3, *[None] * 25, None)
    a, b, c = Q.assessed(spark.createDataFrame([good, poor, none], RECORD), "2024-07-16").orderBy("publication_id").collect()
    assert a.grade == "A" and a.final_score == 100.0 and not a.missing_fields and not a.issue_types and not a.recommendations
    # by hand: 6 of 8, 3 of 9, 4 of 5, 2 of 3, 2 of 5, 3 of 5
    assert [b[f"{d}_score"] for d in Q.WEIGHTS] == [75.0, 33.33, 80.0, 66.67, 40.0, 60.0] and b.final_score == 61.17 and b.grade == "D" and b.missing_fields == ["authors", "external_id"]
    assert {"placeholder_title", "weak_abstract", "invalid_publication_year", "invalid_doi", "invalid_url", "invalid_language", "unnormalized_keywords", "duplicate_keywords", "stale_harvest", "future_publication_year", "missing_license", "record_deleted", "missing_authors"} <= set(b.issue_types)
    assert "invalid_doi: DOI is invalid: bad-doi." in b.validation_errors and "invalid_publication_year: Publication year is unreasonable: 3020." in b.validation_errors
    assert "Provide external id metadata." in b.recommendations
    # eight fields, a title and so on are missing; nothing that is absent is called wrong
    assert c.missing_fields == ["title", "authors", "abstract", "publication_date", "repository_identifier", "external_id", "source_provenance", "raw_metadata", "harvested_at", "article_url"]
    assert c.validation_errors == [] and c.completeness_score == 0.0 and c.validity_score == 66.67 and c.grade == "F"
    only = Q.assessed(spark.createDataFrame([poor], RECORD), "2024-07-16", {"completeness": 10.0, "validity": -3.0}).first()
    # by hand: 10, 0 and the defaults 0.15, 0.15, 0.1, 0.1 over 10.5
    assert only.final_score == 74.48
    rows = Q.issues(spark.createDataFrame([(1, ["doi"], ["invalid_doi: DOI is bad."], [], ["Provide doi metadata."])], "publication_id int, missing_fields array<string>, validation_errors array<string>, warnings array<string>, recommendations array<string>"), "publication_id")
    assert {(r.category, r.issue_type) for r in rows.collect()} == {("missing_field", "missing_doi"), ("validation_error", "invalid_doi"), ("recommendation", "provide_doi_metadata")}


def test_counted_words(spark):
    rows = [(1, ["b", "a", "b", "c", "a", "b"]), (2, []), (3, ["x"]), (4, None)]
    got = {r.i: r for r in S.counted(spark.createDataFrame(rows, "i int, w array<string>"), "w").withColumn("top", S.most_common(F.col("_counts"), 2)).collect()}
    assert [tuple(x) for x in got[1]._counts] == [("a", 2, 1), ("b", 3, 0), ("c", 1, 3)] and [x.term for x in got[1].top] == ["b", "a"]
    assert got[2]._counts == [] and [tuple(x) for x in got[3]._counts] == [("x", 1, 0)] and not got[4]._counts


def test_oai(spark):
    xml = """<OAI-PMH xmlns:x="y"><ListRecords><record><header><identifier>a</identifier><datestamp>2024-01-01</datestamp><setSpec>s1</setSpec></header><metadata><oai_dc:dc>
    <dc:title>Soil &amp; water</dc:title><dc:creator>A</dc:creator><dc:creator> </dc:creator><dc:creator>B</dc:creator></oai_dc:dc></metadata></record>
    <record><header status="deleted"><identifier>b</identifier></header></record><record><header/></record></ListRecords><resumptionToken completeListSize="2" cursor="0">T</resumptionToken></OAI-PMH>"""
    pages = spark.createDataFrame([("s", xml), ("s", '<OAI-PMH><error code="noRecordsMatch"/></OAI-PMH>'), ("s", None)], "source string, xml string")
    a, b, c = X.oai_records(pages).orderBy("position").select("*", X.multimap(F.col("fields")).alias("m")).collect()
    assert a.m == {"title": ["Soil & water"], "creator": ["A", "B"]} and a.sets == ["s1"] and not a.deleted and b.deleted and c.error
    states = X.oai_page_state(pages).select("error_class", "token", "complete_size").collect()
    assert ("empty", None, None) in [tuple(s) for s in states] and (None, "T", 2) in [tuple(s) for s in states]


def test_imports(spark):
    files = spark.createDataFrame([(1, '[{"a": 1}, 3]'), (2, '{"records": [{"a": 1}]}'), (3, '{"items": [{}, {}]}'), (4, '{"a": 1}')], "f int, content string")
    got = X.import_rows(files).groupBy("f").agg(F.count("*").alias("n"), F.count("error").alias("e")).orderBy("f").collect()
    assert [tuple(r) for r in got] == [(1, 2, 1), (2, 1, 0), (3, 2, 0), (4, 1, 0)]


def test_match_by_likeness(spark):
    schema = "publication_id bigint, doi string, source string, external_id string, key_title string, publication_year int, first_author string, is_deleted boolean, updated_at int"
    stored = spark.createDataFrame([(1, "10.1/a", "s", "x1", "soil fertility in the highlands", 2020, "a", False, 1), (2, None, "s", "x2", "water use of crops in the lowlands", 2021, "b", True, 1)], schema)
    new = spark.createDataFrame([(10, "10.1/a", "s", None, "other", 2020, "z"), (11, None, "s", "x2", "other", 2020, "z"), (12, None, "q", "n", "soil fertility in the highland", 2020, "z"), (13, None, "q", "m", "water use of crops in the lowland", 2021, "z")], "record_id bigint, doi string, source string, external_id string, key_title string, publication_year int, first_author string")
    assert {r.record_id: (r.publication_id, r.matched_by) for r in D.match(new, stored).collect()} == {10: (1, "doi"), 11: (2, "external_id"), 12: (1, "title_ratio")}


def test_chunks():
    text = ("A sentence here. " * 400).strip()
    bounds = R.chunk_bounds(text, 3500, 500)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text) and all(b - a <= 3500 for a, b in bounds)
    assert all(y[0] < x[1] and text[x[1] - 1] in ". " for x, y in zip(bounds, bounds[1:]))
    assert R.chunk_bounds("", 10, 2) == []


def test_addresses_and_dates_by_their_rules(spark):
    assert one(spark, S.url, "http://a.b/x;y/z;s=1?q;r#f") == "http://a.b/x;y/z?q;r"
    given = {"2018-06-14aau": "2018-06-14", "02023-12-06": "2023-12-06", "3/4/2022": "2022-03-04", "3/4/71": "1971-03-04", "12/31/68": "2068-12-31", "January, 2025": "2025-01-01", "jan 2025": "2025-01-01", "2023-06": "2023-06-01", "2023": "2023-01-01", " 2024-01-05T23:59:00-05:00 ": "2024-01-05", "1799": None, "2101-01-01": None, "15/06/2023": None, "soon": None, "": None}
    frame = spark.createDataFrame([(k,) for k in given], "t string").select("t", S.tolerant_date(F.col("t")).cast("string").alias("d"))
    assert {r.t: r.d for r in frame.collect()} == given


def test_document_links(spark):
    html = """<a href="a.pdf"><a href='/b/c.PDF?d=1'><img src="//h.org/e.pdf"><a href="http://H.org:80/f.pdf"><a href="https://x.org/g.pdf"><a href="/bitstream/1/2/content"><a href="/h?x=i.pdf"><a href="mailto:a.pdf"><a href="a.pdf">"""
    rows = [(1, "http://h.org/d/page?x=/y", html), (2, "http://h.org", '<a href="a.pdf">'), (3, None, html), (4, "ftp://h.org/", html), (5, "http://h.org/", None)]
    got = {}
    for r in R.document_links(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id", "position").collect():
        got.setdefault(r.page_id, []).append((r.position, r.link))
    assert got == {1: [(0, "http://h.org/d/a.pdf"), (1, "http://h.org/b/c.PDF?d=1"), (2, "http://h.org/e.pdf"), (3, "http://H.org:80/f.pdf"), (5, "http://h.org/bitstream/1/2/content")], 2: [(0, "http://h.org/a.pdf")]}


def test_import_report_and_changes(spark):
    rows = [(None, k, k, f"t{k}", f"t{k}", k % 5 == 0, None if k % 2 else "bad") for k in range(50)] + [("r", 1, 7, "x", None, None, None)]
    frame = spark.createDataFrame(rows, "run string, record_index int, record_id int, title string, key_title string, is_deleted boolean, error string")
    stored = spark.createDataFrame([("t1",), (None,)], "key_title string")
    got = {r.run: r for r in P.import_report(frame, stored, sample=3, most_errors=2).collect()}
    assert (got[None].seen, got[None].valid, got[None].invalid, got[None].active, got[None].deleted, got[None].likely_creates) == (50, 25, 25, 20, 5, 19)
    assert got[None].sample == [1, 3, 5] and [tuple(e) for e in got[None].errors] == [(0, "bad"), (2, "bad")] and got["r"].errors == [] and got["r"].sample == [7]
    kinds = "id int, final_score double, grade string, missing_fields array<string>"
    old, new = spark.createDataFrame([(1, 1.0, "A", ["x"]), (2, None, "B", [])], kinds), spark.createDataFrame([(1, 1.0, "B", ["x", "y"]), (2, None, "B", []), (3, 1.0, "A", [])], kinds)
    changed = {r.id: r.changed for r in P.changed_reports(old, new, "id", ("final_score", "grade", "missing_fields")).collect()}
    assert changed == {1: ["grade", "missing_fields"], 3: ["final_score", "grade", "missing_fields"]}
