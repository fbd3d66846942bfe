"""Mixed values against plain loops over parsed JSON."""

import datetime
import decimal
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions import fields as X
from folioframe.sources import mappings as M
from folioframe.sources import records as R


def texts(row, *keys):
    """What a row says under the first of the names that says anything."""
    inner = row.get("metadata") if isinstance(row.get("metadata"), dict) else {}
    for key in keys:
        found = next((v for v in (row.get(key), inner.get(key)) if v is not None and v != "" and v != []), None)
        said = []
        for one in found if isinstance(found, list) else [found]:
            if isinstance(one, dict):
                one = next((one[k] for k in ("value", "text", "name") if one.get(k)), None)
            if one and str(one).strip():
                said.append(json.dumps(one, separators=(",", ":"), ensure_ascii=False) if isinstance(one, (list, dict)) else str(one).strip())
        if said:
            return said
    return []


def test_alias_values_random(spark):
    rng = random.Random(4)

    def value(depth=0):
        kind = rng.randint(0, 9 if depth < 2 else 6)
        if kind < 7:
            return [None, "", "  ", f" w{rng.randint(0, 9)} ", rng.randint(0, 2), rng.random() < 0.5, "é "][kind]
        return [value(depth + 1) for _ in range(rng.randint(0, 3))] if kind == 7 else {k: value(2) for k in rng.sample(["value", "text", "name", "q"], rng.randint(0, 3))}

    rows = [{k: value() for k in rng.sample(["a", "b.c", "d"], rng.randint(0, 3))} | ({"metadata": {k: value() for k in rng.sample(["a", "b.c", "d"], 2)}} if rng.random() < 0.5 else {}) for _ in range(600)]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "id int, j string").withColumn("v", F.try_parse_json("j"))
    got = {r.id: r.found for r in frame.select("id", M.alias_values(F.col("v"), M.at(F.col("v"), "metadata"), "a", "b.c", "d").alias("found")).collect()}
    assert got == {i: texts(r, "a", "b.c", "d") for i, r in enumerate(rows)}


def test_publications_edges(spark):
    rows = [
        (1, '{"title":"A","authors":"","dc.creator":"X","keywords":[],"subjects":"s; t","year":"99","journal_name":" J ","is_deleted":"false"}'), (2, None), (3, ""), (4, "[1]"), (5, '{"title":'), (6, '{"metadata":[],"title":{"q":1}}'),
        (1, '{"title":"A","title":"B"}'), (7, '{"name":"' + "n" * 70000 + '","dc.subject":["k"],"publication_date":"0000-01"}'),
    ]
    d = spark.createDataFrame(rows, "id int, raw string").withColumns({"error": F.lit("old"), "doi": F.lit("old"), "_row": F.lit(1)})
    got = sorted(M.publications(d).collect(), key=lambda r: (r.id, r.title or ""))
    assert [(r.id, r.error) for r in got] == [(1, M.NO_OBJECT), (1, None), (2, M.NO_OBJECT), (3, M.NO_OBJECT), (4, M.NO_OBJECT), (5, M.NO_OBJECT), (6, M.NO_TITLE), (7, None)]
    a, long = got[1], got[-1]
    assert (a.authors, a.subjects, a.keywords, a.publication_year, a.publication_date, a.journal, a.is_deleted, a.doi) == ([], ["s", "t"], ["s", "t"], 99, datetime.date(99, 1, 1), "J", True, None)
    assert (len(long.title), long.keywords, long.publication_year, long.publication_date) == (70000, ["k"], 0, None)
    assert M.publications(d.limit(0)).count() == 0


@pytest.mark.parametrize("given,want", [(None, None), (" ", None), ("https://hdl.handle.net/1/2/", "1/2"), ("http://hdl.handle.net//", None), ("https://r/x/handle/1/2?q=/handle/9", "1/2"), ("https://r/a;p", "https://r/a;p"), ("/1/2/", "1/2"), ("plain", None), ("https://r/handle/1/2;v=1", "1/2")])
def test_handles(spark, given, want):
    assert spark.createDataFrame([(given,)], "h string").select(M.handle(F.col("h"))).first()[0] == want


def test_landing_records_edges(spark):
    item = {"id": 7, "handle": "none", "metadata": {"dc.identifier.uri": [{"value": " https://b/handle/1/2 "}, {"value": "https://b/handle/1/2"}, {"value": None}, "x"], "dc.title": "not a list", "dc.date.issued": [{"value": "2020"}]}, "name": "N"}
    d = spark.createDataFrame([(1, json.dumps(item)), (2, '{"uuid":" "}'), (3, None), (4, "{"), (5, '{"uuid":"u"}')], "k int, item string").withColumn("title", F.lit("old"))
    got = {r.k: r for r in M.landing_records(d, F.lit("https://b//"), "w").collect()}
    assert set(got) == {1, 5}
    assert (got[1].external_id, got[1].title, got[1].landing_url, got[1].identifiers, got[1].issued_date, got[1].authors) == ("w:1/2", "N", "https://b/handle/1/2", ["https://b/handle/1/2"], "2020", [])
    assert (got[5].external_id, got[5].title, got[5].landing_url) == ("w:u", None, "https://b/items/u")
    plain = {r.k: (r.external_id, r.landing_url) for r in M.landing_records(d, F.lit("https://b")).collect()}
    assert plain == {1: ("7", "https://b/handle/1/2"), 5: ("u", "https://b/items/u")}


def test_landing_url(spark):
    cases = [("a:9", ["https://r/1", "https://r/items/2", "https://r/x9/"], 2), ("a:9", ["https://r/1", "http://r/handle/2"], 1), ("a:9", ["doi", "https://r/1"], 1), ("9", ["doi"], None), ("a:", ["http://r/q/"], 0), ("a:9", [], None)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b array<string>")
    got = {r.i: r.u for r in d.select("i", M.landing_url(F.col("a"), F.col("b")).alias("u")).collect()}
    assert got == {i: None if at is None else links[at] for i, (_, links, at) in enumerate(cases)}


def test_manifest_layouts(spark):
    e = lambda name, k: {"path": f"d/{name}", "k": k}
    files = {
        "list": [e("a", 1), 3, e("b", 2), e("a", 3), {"k": 4}], "documents": {"documents": [e("a", 1)], "items": [e("b", 2)]}, "items": {"documents": {}, "items": {"z": e("a", 1), "y": e("a", 2)}},
        "entries": {"items": 0, "entries": [{"local_path": "", "final_path": "x/a/", "k": 5}]}, "named": {"z": e("a", 1), "b": e("a", 2), "c": "x"}, "text": {"documents": "x"}, "empty": [], "scalar": 5,
    }
    d = spark.createDataFrame([(n, json.dumps(p)) for n, p in files.items()] + [("null", None), ("broken", "[")], "file string, content string").withColumn("base", F.lit("old"))
    got = {(r.file, r.base): r.k for r in M.manifest_entries(d).select("file", "base", F.try_variant_get("entry", "$.k", "int").alias("k")).collect()}
    assert got == {("list", "a"): 3, ("list", "b"): 2, ("documents", "a"): 1, ("items", "a"): 2, ("entries", "a"): 5, ("named", "a"): 2}


def test_array_entries(spark):
    d = spark.createDataFrame([("a", '[{"x":1},[],null,"s",{}]'), ("b", "[]"), ("c", "{}"), ("d", None), ("e", "[1")], "f string, content string")
    assert {r.f: (r.records, r.skipped, r.error is None) for r in M.array_entries(d).collect()} == {"a": (2, 3, True), "b": (0, 0, True), "c": (None, None, False), "d": (None, None, False), "e": (None, None, False)}


def test_json_safe(spark):
    kind = T.StructType.fromDDL("t timestamp, n timestamp_ntz, d date, x decimal(10,3), l array<struct<d:date,x:decimal(5,1)>>, m map<date,array<decimal(4,2)>>, s string, i int")
    day, time = datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 1, 2, 3, 40)
    d = spark.createDataFrame([((time, time, day, decimal.Decimal("1.500"), [(day, decimal.Decimal("2.0")), None], {day: [decimal.Decimal("0.10"), None]}, "s", 3),), (None,)], T.StructType().add("v", kind))
    got = [r.j and json.loads(r.j) for r in d.select(F.to_json(X.json_safe(F.col("v"), kind), {"ignoreNullFields": "false"}).alias("j")).collect()]
    iso = "2024-02-29T01:02:03.000040"
    assert got == [{"t": iso + "+00:00", "n": iso, "d": "2024-02-29", "x": "1.500", "l": [{"d": "2024-02-29", "x": "2.0"}, None], "m": {"2024-02-29": ["0.10", None]}, "s": "s", "i": 3}, None]


def test_document_files(spark, tmp_path):
    for name, head in (("a.pdf", b"%PDF-1.7"), ("sub/b.docx", b"PK\x03\x04"), ("c.pdf", b"none"), ("d.txt", b"%PDF")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(head)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.kind) for r in R.document_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (8, "pdf"), "b.docx": (4, "docx"), "c.pdf": (4, None)}
