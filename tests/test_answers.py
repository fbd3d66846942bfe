"""Selection, reranking, packing, duplicates and nearest vectors against plain loops."""

import itertools
import random
import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from folioframe.functions import fields as X
from folioframe.operators import answers as A
from folioframe.operators import identity as D
from folioframe.operators import retrieval as R


def terms(text):
    return {w for w in re.findall(r"\w+", text.casefold()) if len(w) > 2}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def tokens(text):
    return max(1, len(re.findall(r"\w+|[^\w\s]", text)), -(-len(text.encode()) // 3)) if text else 0


def test_selected_chunks(spark):
    schema = "query_id int, question string, document_id string, title string, chunk_id int, content string, similarity double, rank int"
    broad = [(1, "yield of teff", d, f"Title {d}", i, "teff yield" if d != "z" else "nothing", 0.9 - i / 100 if d != "z" else 0.5, i) for i, d in enumerate("aaaaabbbbzzcdefgh")]
    named = [(2, "explain soil fertility in the highlands", d, "Soil fertility highlands" if d == "a" else "Other", 100 + i, "soil", 0.9, i) for i, d in enumerate("aabaaaaaaaaaaab")]
    got = {}
    for r in A.selected_chunks(spark.createDataFrame(broad + named, schema), top_documents=4).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    # three of the first document, two of another; z is weak and shares no word; four documents at most
    assert got[1] == [0, 1, 2, 5, 6, 11, 12]
    # a named document gives up to twelve; another one only while it gave fewer than three
    assert got[2] == [100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 110, 111, 112]


def test_reranked(spark):
    base = "soil fertility declines where crops are grown without rest in the highlands of the country"
    rows = [
        (1, "soil fertility highlands", 1, "d", 1, "A", base, 0.9, 0), (1, "soil fertility highlands", 2, "e", 5, "B", base + "!", 0.8, 1), (1, "soil fertility highlands", 3, "d", 2, "A", "crops are grown without rest where soil fertility declines in the highlands of the country and", 0.7, 2),
        (1, "soil fertility highlands", 4, "d", 9, "A", "entirely different words about trade", None, 3), (1, "soil fertility highlands", 5, None, None, None, None, 0.1, 4),
    ]
    got = A.reranked(spark.createDataFrame(rows, "query_id int, question string, id int, document_id string, chunk_index int, title string, text string, similarity double, rank int")).orderBy("place").collect()
    q = terms(rows[0][1])
    want = {1: 0.9 * 0.65 + 0.35 * jaccard(q, terms("A " + base)), 3: 0.7 * 0.65 + 0.35 * jaccard(q, terms("A " + rows[2][6])) - 0.2 - 0.0002, 4: 0.35 * jaccard(q, terms("A " + rows[3][6])) - 0.0003, 5: 0.1 * 0.65 - 0.0004}
    assert {r.id: round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert [r.id for r in got] == sorted(want, key=lambda k: -want[k])


def test_packed(spark):
    long = " ".join(f"Sentence {i} on the soil has a result of {i} percent in the farms of the north." for i in range(200))
    rows = [(1, "soil result", "be brief", "", k, f"T{k}", "d", None, 1, None, t, k) for k, t in enumerate(["Copyright © x\nShort text on soil.", long, "  ", "tail. " * 900, "last words", "more", "even more"])]
    schema = "query_id int, question string, system string, history string, id int, title string, document_id string, section string, page_start int, page_end int, text string, place int"
    got = A.packed(spark.createDataFrame(rows, schema)).orderBy("label").collect()
    assert [r.label for r in got] == [f"S{k + 1}" for k in range(len(got))] and len(got) <= 5
    assert got[0].text == "Short text on soil." and not got[0].compressed and got[1].compressed and 2 not in [r.id for r in got]
    assert all(r.tokens == tokens(r.text) <= 800 for r in got) and sum(r.tokens for r in got) <= 2600
    none = A.packed(spark.createDataFrame([(*r[:2], "word " * 9000, *r[3:]) for r in rows], schema))
    assert none.count() == 0
    cut = spark.createDataFrame([("One two. Three four five.",), ("onetwothree four",), ("x" * 90,), (" One two. ",)], "t string").select(A.cut_to(F.col("t"), 5).alias("c")).collect()
    assert [r.c for r in cut] == ["One two.", "onetwothree", "", "One two."]


def test_packed_by_loops(spark):
    """Every text and count against a plain loop over the sentences."""
    rng = random.Random(3)
    words = "soil water yield 12% result method the farm 7.5 Findings of a".split()
    text = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(2, 14))).capitalize() + rng.choice(".!?") + rng.choice([" ", "  ", chr(10)]) for _ in range(n))
    rows = [(q, "soil yield result", "be brief", "", k, f"T{k}", "d", None, 1, 4, text(rng.randint(1, 150)), k) for q in range(8) for k in range(9)]
    schema = "query_id int, question string, system string, history string, id int, title string, document_id string, section string, page_start int, page_end int, text string, place int"
    got = {}
    for r in A.packed(spark.createDataFrame(rows, schema)).orderBy("query_id", "label").collect():
        got.setdefault(r.query_id, []).append((r.id, r.text, r.tokens, r.compressed))
    asked, want = terms("soil yield result"), {}
    for q in range(8):
        own = [r for r in rows if r[0] == q]
        left = max(0, min(2600, 4096 - tokens("soil yield result") - tokens("be brief") - sum(tokens(f"{r[5]} d pages 1-4") for r in own[:5]) - 900))
        want[q] = []
        for r in own:
            limit = min(800, left)
            whole = " ".join(line.strip() for line in r[10].splitlines() if line.strip())
            if len(want[q]) == 5 or left <= 0:
                break
            if tokens(whole) > limit:
                parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", whole) if p.strip()]
                weight = {k: 3 * len(asked & terms(p)) + 2 * sum(m in p.lower() for m in A.PACKED_MARKS) + 2 * bool(re.search(r"\b\d+(?:\.\d+)?%?\b", p)) for k, p in enumerate(parts)}
                keep, used = [], 0
                for k in sorted(weight, key=lambda k: (-weight[k], k)):
                    if used < min(limit, 400) and used + tokens(parts[k]) <= limit:
                        keep.append(k)
                        used += tokens(parts[k])
                short, long = " ".join(parts[k] for k in sorted(keep)), True
            else:
                short, long = whole, False
            if short and tokens(short) <= left:
                want[q].append((r[4], short, tokens(short), long))
                left -= tokens(short)
    assert got == want and any(long for rs in want.values() for *_, long in rs) and any(not long for rs in want.values() for *_, long in rs)


def test_pinned_and_named(spark):
    schema = "query_id int, question string, document_id string, title string, chunk_id int, content string, similarity double, rank int, pinned boolean"
    rows = [(1, "teff yield", "a", "T", 1, "teff", 0.9, 0, False), (1, "teff yield", "b", "U", 2, "teff", 0.1, 1, True), (1, "teff yield", "c", "V", 3, "teff", 0.1, 2, None)]
    assert [r.chunk_id for r in A.selected_chunks(spark.createDataFrame(rows, schema), least=0.5).orderBy("position").collect()] == [1, 2]
    chunks = spark.createDataFrame([(q, "p", k) for q in (1, 2) for k in range(3)], "query_id int, publication_id string, position int")
    rest = spark.createDataFrame([(1, "q", 0), (2, "q", 0)], "query_id int, publication_id string, position int")
    got = A.assembled(chunks, rest, 9, spark.createDataFrame([(2,)], "query_id int")).where("source_type = 'publication'").collect()
    assert [r.query_id for r in got] == [1]


def test_answer_sentences(spark):
    a, b = "The main finding is that soil fertility declines in the north", "Water use of crops is not what this sentence is about at all"
    rows = [(1, "soil fertility", 0, "My Study!", f"{b}. {a}. Short one."), (1, "soil fertility", 1, "my study", f"{a.upper()}. {b}?"), (1, "soil fertility", 2, "Other", f"{a} elsewhere."), (2, "x", 0, "T", " ")]
    got = [(r.rank, r.sentence) for r in A.answer_sentences(spark.createDataFrame(rows, "query_id int, question string, place int, title string, text string")).orderBy("query_id", "rank").collect()]
    assert got == [(1, a + "."), (2, b + "."), (3, b + "?")]


def test_assembled(spark):
    chunks = spark.createDataFrame([(1, "p", "c1", 0), (1, "p", "c2", 1)], "query_id int, publication_id string, chunk_id string, position int")
    rest = spark.createDataFrame([(1, "p", 0), (1, "q", 1), (1, "r", 2)], "query_id int, publication_id string, position int")
    assert [(r.publication_id, r.source_type) for r in A.assembled(chunks, rest, 3).orderBy("place").collect()] == [("p", "document_chunk"), ("p", "document_chunk"), ("q", "publication")]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_duplicate_pairs_by_loops(spark):
    rng = random.Random(5)
    words = "soil water crop farm yield tree seed rain".split()
    rows = []
    for i in range(200):  # 120 titles with one opening, and others
        opening = "a study of soil" if i < 120 else " ".join(rng.choice(words) for _ in range(4))
        title = f"{opening} {' '.join(rng.choice(words) for _ in range(rng.randint(0, 4)))}".strip()
        rows.append((i, f"10.1/{i // 2}" if i % 40 < 2 else None, title, None if i % 3 == 0 else " ".join(rng.choice(words) for _ in range(50)), [rng.choice("abc"), rng.choice("abc")], 2000 + rng.randint(0, 3)))
    want = {}
    for a, b in itertools.combinations(rows, 2):
        same = a[1] is not None and a[1] == b[1]
        held = any(" ".join(x[2].split()[:4]) in y[2] for x, y in ((a, b), (b, a)))
        if not same and not held:
            continue
        gap, s, t = abs(a[5] - b[5]), set(a[4]), set(b[4])
        score = 1.0 if same else 0.4 * ratio(a[2], b[2]) + (0.3 * ratio(a[3], b[3]) if a[3] and b[3] else 0) + 0.2 * len(s & t) / min(len(s), len(t)) + 0.1 * (1.0 if gap == 0 else 0.5 if gap == 1 else 0)
        if score >= 0.65:
            want[a[0], b[0]] = round(score, 3)
    frame = spark.createDataFrame([(*r[:4], sorted(set(r[4])), r[5]) for r in rows], "publication_id int, doi string, key_title string, abstract string, authors array<string>, publication_year int")
    got = {(r.first_id, r.second_id): round(r.score, 3) for r in D.duplicate_pairs(frame).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.002 for k in want)
    assert sum(a < 120 and b < 120 for a, b in want) > 100  # more than a limit of 50 titles an opening would leave


def test_dois_that_many_share(spark):
    """One placeholder DOI gives a pair a record, not all pairs; a deleted record is no one's duplicate; short titles lead too."""
    rows = [(i, "10.1/X" if i % 2 else "10.1/x", f"title number {i} apart", None, ["a"], 1900 + 3 * i, False) for i in range(40)]
    rows += [(100, None, "soil", "same abstract", ["a"], 2000, False), (101, None, "soils", "same abstract", ["a"], 2000, False), (102, None, "subsoil", "same abstract", ["a"], 2000, True)]
    frame = spark.createDataFrame(rows, "publication_id int, doi string, key_title string, abstract string, authors array<string>, publication_year int, is_deleted boolean")
    got = {(r.first_id, r.second_id) for r in D.duplicate_pairs(frame).collect()}
    assert got == {(0, i) for i in range(1, 40)} | {(100, 101)}
    assert [tuple(r) for r in D.doi_classes(frame).collect()] == [("10.1/x", 0, 40)]


def test_letter_prefixes_are_few(spark):
    titles = spark.createDataFrame([(f"a study of water and soil in field {i} of the northern highlands",) for i in range(50)], "t string")
    shares = D.letter_shares(titles, "t")
    assert titles.select(F.max(F.size(D.letter_prefix(F.col("t"), 0.92, shares))).alias("n")).first().n <= 11 and abs(sum(shares.values()) - 1) < 1e-9


def test_nearest_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 4))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(20, [float("nan")] * 4), (21, [float("inf"), 0.0, 0.0, 0.0]), (22, None), (23, [0.0] * 4), (24, [1.0, None, 0.0, 0.0]), (25, [1.0, 2.0]), (26, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "id int, v array<double>")
    got = {}
    for r in R.nearest(frame, frame, 13, id_col="id", vector_col="v").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(got[i] == [j for j in np.argsort(-(u @ u[i]), kind="stable").tolist() if j != i] for i in range(12))
    assert got[25] == [26] and got[26] == [25] and not got.keys() & {20, 21, 22, 23, 24}


def test_labelled_text(spark):
    row = spark.createDataFrame([(["A <b>title</b>"], ["a title", "soil"], ["Soil", "Crop"], None)], "t array<string>, a array<string>, k array<string>, n array<string>")
    text = X.labelled_text({"Title": F.col("t"), "Abstract": F.col("a"), "Keywords": F.col("k"), "Journal": F.col("n")}, twice="Title")
    assert row.select(text.alias("x")).first().x == "Title:\nA title\nA title\n\nAbstract:\nsoil\n\nKeywords:\nCrop"
