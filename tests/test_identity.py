"""Identity operators against brute force."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd

from folioframe.operators import identity, likeness

RECORD = "record_id long, doi string, source string, external_id string, key_title string, publication_year int, first_author string"
STORED = RECORD.replace("record_id", "publication_id") + ", is_deleted boolean, updated_at long"


def test_match_reaches_all_rows_of_the_year(spark):
    rng = random.Random(3)
    words = "soil water crop farm study data yield tree seed rain field".split()
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(260)] + ["", "a"]
    stored = [(i, None, None, None, t, 2001 if i % 20 == 0 else 2000, None, i % 17 == 0, i) for i, t in enumerate(titles)] + [(999, None, None, None, None, 2000, None, False, 0)]

    def changed(t):
        k = rng.randint(0, len(t))
        return t[:k] + rng.choice(["", "s", "xx"]) + t[k + rng.randint(0, 2) :]

    records = [(1000 + i, None, None, None, changed(t), 2000, None) for i, t in enumerate(titles)] + [(2000, None, None, None, None, 2000, None)]
    want = {}
    for r in records:
        found = []
        for s in stored:
            if r[4] is not None and s[4] is not None and s[5] == r[5] and not s[7]:
                score = SequenceMatcher(None, r[4], s[4], autojunk=False).ratio()
                if score >= 0.92:
                    found.append((-score, s[0]))
        if found:
            want[r[0]] = min(found)[1]
    got = {r.record_id: r.publication_id for r in identity.match(spark.createDataFrame(records, RECORD), spark.createDataFrame(stored, STORED)).collect()}
    assert got == want and len(want) > 150


def test_match_of_numbered_titles_meets_few(spark, monkeypatch):
    """Titles that differ in a number only: each record meets a few of its year's rows, and the best is exact; with and without its own row."""
    rng = random.Random(7)
    kinds = ["1urgent", "2high", "4not specified", "5low"]
    numbers = rng.sample(range(10, 120000), 3000)
    stored = [(i, None, None, None, f"study {n} of {kinds[n % 4]}", 2000, None, i % 3 == 0, i) for i, n in enumerate(numbers)]
    stored += [(5000 + i, None, None, None, "", 2000, None, False, 0) for i in range(2)] + [(6000, None, None, None, "7" * 60, 2000, None, False, 0)]
    records = [(i, None, None, None, stored[i][4] + "s", 2000, None) for i in range(0, 3000, 60)] + [(i, None, None, None, stored[i][4] + "s", 2000, None) for i in range(1, 3000, 300)]
    records += [(7000, None, None, None, "", 2000, None), (7001, None, None, None, "7" * 58, 2000, None), (7002, None, None, None, "a title of other words", 2000, None), (7003, None, None, None, "study of 5low", 2000, None)]
    want = {}
    for r in records:
        m, best = SequenceMatcher(None), None
        m.set_seq2(r[4])
        for s in stored:
            m.set_seq1(s[4])
            if not s[7] and m.real_quick_ratio() >= 0.92 and m.quick_ratio() >= 0.92:
                score = SequenceMatcher(None, r[4], s[4]).ratio()
                if score >= 0.92 and (best is None or (-score, s[0]) < best):
                    best = (-score, s[0])
        if best:
            want[r[0]] = best[1]
    met, scored = [], identity.scored_titles

    def counted(pairs, least):
        met.append(pairs.select("record_id", "publication_id").distinct().count())
        return scored(pairs, least)

    monkeypatch.setattr(identity, "scored_titles", counted)
    got = {r.record_id: r.publication_id for r in identity.match(spark.createDataFrame(records, RECORD), spark.createDataFrame(stored, STORED)).collect()}
    assert got == want and len(want) > 30
    assert 50 * sum(met) < len(records) * len(stored)


def test_duplicate_pairs_of_a_crowded_opening(spark):
    """Titles of six words with one opening of four, each twice with another last word."""
    rng = random.Random(4)
    rows = [(i, None, f"notes on the soil {'abcdefghijklmnop'[i % 16]}{i // 2:03d} {'abcdefghij'[i // 2 % 10] * 9}{'xy'[i % 2]}", f"text {i // 2} " * 5, [f"author {i // 2}"], 2000 + i // 2 % 9) for i in range(160)]
    rng.shuffle(rows)
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                gap = abs(a[5] - b[5])
                score = 0.4 * SequenceMatcher(None, a[2], b[2], autojunk=False).ratio() + 0.3 * SequenceMatcher(None, a[3], b[3], autojunk=False).ratio() + 0.2 * (a[4] == b[4]) + 0.1 * (1 if gap == 0 else 0.5 if gap == 1 else 0)
                if score >= 0.65:
                    want.add((a[0], b[0]))
    got = identity.duplicate_pairs(spark.createDataFrame(rows, "publication_id long, doi string, key_title string, abstract string, authors array<string>, publication_year int"))
    assert {(r.first_id, r.second_id) for r in got.collect()} == want and len(want) >= 80


def test_ratios_of_long_texts(spark, monkeypatch):
    """Against SequenceMatcher itself: the bound is never below what it matches, few pairs come to it, and texts aren't copied for each pair."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu" * 6 + "cmfwypvbgkjqxz") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    opening = " ".join(words[:12])
    texts = {i: " ".join([opening] * (i % 2) + [rng.choice(words) for _ in range(rng.choice([0, 3, 120, 200]))]) for i in range(40)}
    texts |= {100 + i: t[:200] + rng.choice(["", "xx", "漢"]) + t[203:] for i, t in texts.items() if t} | {200: "aaaa " * 90, 201: "aaaa " * 80 + "b"}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            y = likeness.Text(texts[b])
            if a < b and y.rare is not None:
                x, tables = likeness.Text(texts[a]), {n: np.zeros(1 << likeness.TABLE, bool) for n in likeness.RUNS}
                for n, held in tables.items():
                    held[x.runs[n]] = True
                m = SequenceMatcher(None, texts[a], texts[b])
                if m.real_quick_ratio() >= 0.5:
                    assert likeness.most_matched(x, y, tables) >= sum(n for _, _, n in m.get_matching_blocks())
    pairs = [(a, b, rng.choice([-0.1, 0.5, 0.8])) for a in ids for b in ids if a < b and rng.random() < 0.3]
    want = {(a, b): r for a, b, needed in pairs if (r := SequenceMatcher(None, texts[a], texts[b]).ratio()) >= needed}
    frame = spark.createDataFrame(pairs, "first_id long, second_id long, needed double")
    got = {(r.first_id, r.second_id): r.ratio for r in likeness.ratios(frame, spark.createDataFrame(list(texts.items()), "id long, text string")).collect()}
    assert got == want
    tried = []
    monkeypatch.setattr(likeness, "SequenceMatcher", lambda *a: tried.append(1) or SequenceMatcher(*a))
    far = pd.DataFrame([(a, b, 0.8) for a, b, _ in pairs if b < 100 and len(texts[a]) > 300 and len(texts[b]) > 300], columns=["first_id", "second_id", "needed"])
    assert not len(likeness.cell_ratios(far, pd.DataFrame(texts.items(), columns=["id", "text"]))) and len(tried) < len(far) / 4


def test_pairs_of_one_title_need_an_author_or_a_text(spark):
    """Records of one short title: with an author in common or alike texts only; deleted ones, null and empty fields; against a plain loop."""
    rng = random.Random(10)
    rows = [(i, None if i % 9 else f"10.1/D{i % 4}", rng.choice(["na", "na", "banana tree of the wood", "soils", None]), rng.choice([None, f"text {i % 5} of water", "z" * (i % 7 + 1)]), rng.choice([[], None, ["a"], ["b", "a"], ["c", None], [None]]), rng.choice([None, 2000, 2001, 2005]), i % 11 == 0) for i in range(90)]
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    head = lambda t: " ".join((t or "").split(" ")[:4])
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] is None and b[1] is None and a[2] and b[2] and ((head(a[2]) in b[2] and not b[6]) or (head(b[2]) in a[2] and not a[6])):
                x, y = set(a[4] or []), set(b[4] or [])
                years = 0 if a[5] is None or b[5] is None else {0: 1, 1: 0.5}.get(abs(a[5] - b[5]), 0)
                score = 0.4 * ratio(a[2], b[2]) + (0.3 * ratio(a[3], b[3]) if a[3] and b[3] else 0) + (0.2 * len(x & y) / min(len(x), len(y)) if x and y else 0) + 0.1 * years
                if abs(score - 0.65) > 1e-9 and score >= 0.65:
                    want[a[0], b[0]] = score
    frame = spark.createDataFrame([r for r in rows if r[1] is None], "publication_id long, doi string, key_title string, abstract string, authors array<string>, publication_year int, is_deleted boolean")
    got = {(r.first_id, r.second_id): r.score for r in identity.duplicate_pairs(frame).collect()}
    assert {k for k, s in got.items() if abs(s - 0.65) > 1e-4} == {k for k, s in want.items() if abs(s - 0.65) > 1e-4} and len(want) > 50
    assert all(abs(got[k] - s) < 1e-4 for k, s in want.items() if k in got)
