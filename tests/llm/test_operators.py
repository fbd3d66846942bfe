"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioframe.llm import bpe, common, covertree, decontamination, jaccard, language, lines, mixing, packing, simhash, substrings, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, key string"
WORDS = "the of and to in soil water crop farm study data yield tree seed rain field".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", str(rng.randint(0, 9))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = prose(rng, 30)
    out = []
    for i in range(60):
        t = prose(rng, rng.randint(1, 120))
        if i % 5 == 0:
            t = t[: len(t) // 2] + " " + passage + " \n" + t[len(t) // 2 :]
        out.append((i, t, "en", f"s{i % 4}", len(t), i, "k"))
    out += [(60, None, None, None, None, 0, None), (61, "", "en", "s1", 0, 1, "x"), (62, " \t\n ", "en", "s1", 4, 1, "x"), (63, out[5][1], "en", "s2", 9, 1, "x"), (64, out[5][1].replace("the", "tee", 1), "en", None, 9, 1, "x")]
    out += [(7, out[7][1], "en", "s3", 9, 1, "x"), (8, "other text under a used id", "en", "s0", 9, 1, "x"), (None, out[5][1], "en", "s0", 9, 1, "x"), (65, prose(rng, 30000), "en", "s1", 1, 1, "x"), (66, "é" * 3000 + " 漢字 x́   <|endoftext|>", "fr", "s1", 1, 1, "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def many(it):
    out = defaultdict(list)
    for k, v in it:
        out[k].append(v)
    return {k: sorted(v, key=repr) for k, v in out.items()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def roots(n, near):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if near(i, j):
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    g = defaultdict(set)
    for a, b in edges:
        g[a].add(b)
        g[b].add(a)
    for start in g:
        seen, todo = {start}, [start]
        while todo:
            for y in g[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        if len(seen) > 1:
            assert found[start] == min(seen)
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_token_counts(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = many((r[0], (len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids))) for r in rows)
    got = bpe.token_counts(docs, path).collect()
    assert many((r.doc_id, (r.n_bytes, r.n_tokens)) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert bpe.token_counts(nothing, path).count() == 0


def test_token_counts_of_odd_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rng = Tokenizer.from_file(path), bpe.Counter(path), random.Random(2)
    signs = " \n\t ab'sdtlvemreé²٣漢́\x1c\x85\xa0 😀<|>1_."
    for i in range(3000):
        s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        s = s[:9] + "<|endoftext|>" + s[9:] if i % 7 == 0 else s
        assert own.count(s) == len(library.encode(s, add_special_tokens=False).ids), repr(s)
    assert own.count("ab" * 20000) == len(library.encode("ab" * 20000, add_special_tokens=False).ids)


def test_packing(docs, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for r in order:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in packing.packed_digest(docs, path).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    assert packing.packed_digest(nothing, path).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 11, 16, 17, 32])
def test_pack_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 10001, dtype=np.uint64).astype(np.uint32)
    p = packing.pack(x, bits, 1000)
    assert (packing.unpack(p) == x).all() and (packing.unpack(p, 999, 5003) == x[999:5003]).all() and len(packing.unpack(p, 7, 7)) == 0
    assert len(packing.unpack(packing.pack(x[:0], bits))) == 0
    if bits < 32:
        with pytest.raises(ValueError):
            packing.pack(np.array([1 << bits], np.uint32), bits)


def test_encoder_of_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), packing.encoder(path), random.Random(3)
    signs = " \n\t ab'sdtlvemreé²٣漢̱́HhIİ\x1c\x85\xa0😀<|>1_ABΣς.,Åß"
    for i in range(3000):
        s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        s = s[:9] + "<|endoftext|>" + s[9:] if i % 7 == 0 else s
        assert own.ids(s.encode()) == np.array(library.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), repr(s)


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    size, total = defaultdict(int), 0
    for r in rows:
        size[r[3]] += len(words_of(r[1]))
    total = sum(size.values())
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            open_.remove(s)
    target |= share
    taken = defaultdict(int)
    for r in got:
        assert r._size == len(words_of(r.text)) and r._source_size == size[r.source] and abs(r._target - target[r.source]) < 1e-6
        assert 0 <= r._taken <= 3 * r._size
        taken[r.source] += r._taken
    for s in sources:
        assert target[s] - 1.001 <= taken[s] <= target[s] + 1e-6
    again = mixing.mix(docs.repartition(3)).collect()
    assert many((r.doc_id, r._taken) for r in got) == many((r.doc_id, r._taken) for r in again)
    copies = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        copies[r.source] += len(words_of(r.text))
    assert copies == {s: t for s, t in taken.items() if t}
    assert mixing.mix(nothing).count() == 0


def test_mixing_ranges_stay_small_without_latin_letters(spark):
    d = spark.createDataFrame([(i, "почва и вода " * 3, "ru") for i in range(3000)], "doc_id bigint, text string, source string")
    assert max(r["count"] for r in mixing.mix(d).groupBy("_range").count().collect()) < 30


def test_near_duplicates(docs, rows, nothing):
    def mark(t):
        w = words_of("".join(c.lower() if c.isascii() else c for c in t or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))

    fps = [mark(r[1]) for r in rows]
    root = roots(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {}
    for r, k in zip(rows, root):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    got = simhash.near_duplicates(docs).collect()
    assert many((r.doc_id, (r.fingerprint, r.component_id)) for r in got) == many((r[0], (f"{f:016x}", least[k])) for r, f, k in zip(rows, fps, root))
    assert simhash.near_duplicates(nothing).count() == 0


def test_near_copies(spark, rows, nothing):
    rng = random.Random(12)
    base = prose(rng, 200).split()
    made = [list(r[:2]) for r in rows]
    for k in range(40):  # a crowd of near copies, and the same text with more and more words changed
        made.append([1000 + k, " ".join(base[:k] + ["other"] + base[k + 1 :])])
        made.append([2000 + k, " ".join(w if i * k % 211 > k // 4 else f"x{i}" for i, w in enumerate(base))])
        made.append([3000 + k, prose(rng, 2) + " all rights reserved by the owners of the soil study and of its data"])
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words_of("".join(c.lower() if c.isascii() else c for c in t or "")) for _, t in made)]
    root = roots(len(made), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = jaccard.near_copies(spark.createDataFrame(made, "doc_id bigint, text string").repartition(5)).collect()
    of = {(r.doc_id, r._tid): r._group for r in got}
    assert len(got) == len(made) and len({root[i] for i in range(len(made))}) == len(set(of.values()))
    group = defaultdict(set)
    for r in got:
        group[r._group].add(r.doc_id)
    want = defaultdict(set)
    for (i, _), k in zip(made, root):
        want[k].add(i)
    assert sorted(map(repr, (sorted(v, key=repr) for v in group.values()))) == sorted(map(repr, (sorted(v, key=repr) for v in want.values())))
    assert jaccard.near_copies(nothing).count() == 0


def test_sketches_never_say_too_little():
    rng = np.random.default_rng(11)
    for _ in range(300):
        both = rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 300))
        x, y = (np.unique(np.concatenate([both, rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 500))])) for _ in range(2))
        most = jaccard.most_shared(jaccard.sketch(x), jaccard.sketch(y))
        assert len(np.intersect1d(x, y)) <= most <= min(len(x), len(y))
    assert jaccard.sketch(np.zeros(300, np.int64)) == b"" and jaccard.most_shared(b"", jaccard.sketch(x)) is None
    h = rng.integers(0, 1 << 63, 101, dtype=np.uint64)
    assert simhash.majority(h) == sum(1 << k for k in range(64) if sum(int(v) >> k & 1 for v in h) > 50)


def test_pipeline_near_copies_go(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = prose(random.Random(13), 100).split()
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(base[:40] + ["changed"] + base[41:70] + ["too"] + base[71:]), "en", "s", 1), (3, prose(random.Random(14), 100), "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).bit_count() > 4
    assert sorted(r.doc_id for r in pipeline.near_duplicate(spark, d, "").collect()) == [1, 3]


def test_pipeline_keeps_one_row_a_group(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (prose(random.Random(k), 60) for k in (15, 16, 17))
    rows = [(7, a), (7, b), (9, b), (None, a), (None, c), (None, c), (3, c), (8, None), (8, a + " x"), (5, "one"), (5, "one"), (6, "two"), (None, "three"), (None, "three")]
    d = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipeline.near_duplicate(spark, d.repartition(3), "").collect()
    want = [(7, a), (7, b), (3, c), (8, None), (5, "one"), (6, "two"), (None, "three")]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)


def test_parted_loses_no_partner(spark, monkeypatch):
    monkeypatch.setattr(common, "BITS", 128)  # so full that keys share bits
    big = spark.createDataFrame([(k if k % 7 else None, str(k % 3)) for k in range(300)], "k bigint, s string")
    small = spark.createDataFrame([(5, "2"), (8, "2"), (None, "0"), (1000, "1")], "k int, s string")
    may, rest = common.parted(big, small, ["k", "s"])
    keys = {tuple(r) for r in small.collect()}
    first, second = ([tuple(r) for r in d.collect()] for d in (may, rest))
    assert sorted(first + second, key=repr) == sorted((tuple(r) for r in big.collect()), key=repr)
    assert sum(r in keys for r in first) == 2 + 15 and not any(r in keys for r in second) and len(second) > 200
    none = common.parted(big, small.limit(0), ["k", "s"])
    assert [d.count() for d in none] == [0, 300]


def shuffled(spark) -> int:
    """Bytes that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    doubles = sc._gateway.new_array(sc._gateway.jvm.double, 0)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, doubles, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_pipeline_near_copies_move_few_texts(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(19)
    texts = [" ".join("%016x" % x * 500 for x in rng.integers(0, 1 << 62, 4)) + rng.bytes(15000).hex() for _ in range(100)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate([*texts, texts[3], texts[4]])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/d")
    kept, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where no list is small
    try:
        got = pipeline.near_duplicate(spark, spark.read.parquet(f"{tmp_path}/d"), "").select("doc_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sorted(r.doc_id for r in got) == list(range(100))
    assert shuffled(spark) - before < 15000 * 100 / 2


def test_fuzzy_keys_miss_no_pair():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * 2 + rng.integers(0, 2, 3000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for p in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(p))
    sides = []
    for x in (a, b):
        keys = [set() for _ in x]
        for r, k in zip(*simhash.fuzzy_keys(x)):
            keys[r].add(int(k))
        sides.append(keys)
    assert all(x & y for x, y in zip(*sides))


def test_linked_of_large_groups():
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate([rng.integers(0, 1 << 63, 2000, dtype=np.uint64), np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))]))
    d = np.bitwise_count(x[:, None] ^ x[None]) <= 4
    place = {int(v): i for i, v in enumerate(x)}
    p, q = simhash.linked(x)
    assert (simhash._roots(len(x), *np.nonzero(d)) == simhash._roots(len(x), np.array([place[int(v)] for v in p]), np.array([place[int(v)] for v in q]))).all()


def substrings_left(rows):
    first = {}
    for r in rows:
        w = words_of(r[1])
        for i in range(len(w) - 12):
            if r[0] is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, r[0]), r[0])
    want = []
    for r in rows:
        w = words_of(r[1])
        gone = set()
        for i in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[i : i + 13])] < r[0]:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())))
    return many(want)


def substrings_found(frame):
    return many((r.doc_id, (r._n_words, r._n_removed, r._sha256)) for r in substrings.substring_dedup(frame).collect())


def test_substrings(docs, rows, nothing):
    assert substrings_found(docs) == substrings_left(rows)
    assert substrings.substring_dedup(nothing).count() == 0


def test_substrings_with_ids_of_letters(spark, rows):
    named = [(None if r[0] is None else ["7", "007", "x"][r[0] % 3] + str(r[0] // 3), r[1], "clash") for r in rows]
    assert substrings_found(spark.createDataFrame(named, "doc_id string, text string, first string")) == substrings_left(named)


def test_substrings_of_crowded_shards(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rng = random.Random(9)
    common_line = prose(rng, 14)
    rows = [(i, " ".join([prose(rng, 2), common_line, prose(rng, rng.randint(0, 3)), "end"])) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for crowded in (5000, 20, 2, 1):  # at last the shards are single windows
        monkeypatch.setattr(substrings, "CROWDED", crowded)
        assert substrings_found(frame) == substrings_left(rows)


def test_automaton():
    a = substrings.SuffixAutomaton()
    a.add(list("abcbc"))
    a.add(list("bcbd"))
    assert a.matching(list("xabcbdz")) == [0, 1, 2, 3, 4, 4, 0] or a.matching(list("xabcbdz"))[:5] == [0, 1, 2, 3, 4]
    text = ["abcbc", "bcbd"]
    for q in ("xabcbdz", "cbcbdabc"):
        want = [max((n for n in range(k + 2) if any(q[k + 1 - n : k + 1] in t for t in text)), default=0) for k in range(len(q))]
        assert a.matching(list(q)) == want


def test_decontamination(spark, docs, rows, nothing):
    w0 = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rows[5][1].lower())
    items = [(1, " ".join(w0[2:25]).upper()), (2, "crop"), (3, None), (4, "?!"), (5, "nothing of this kind"), (1, rows[9][1]), (None, " ".join(w0[:11]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def lower(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = []
    for item, t in items:
        w = lower(t)
        windows += [(item, w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)]
    want = []
    for r in rows:
        w, hit, who = lower(r[1]), set(), set()
        places = defaultdict(list)
        for i, x in enumerate(w):
            places[x].append(i)
        for item, x in windows:
            for i in places.get(x[0], []):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    who |= {str(item)} if item is not None else set()
        ids = ",".join(sorted(who))
        want.append((r[0], (len(w), len(hit), len(who), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))))
    for words in (decontamination.BLOCK_WORDS, 20):  # one block, and several
        got = decontamination.digest(decontamination.contamination(docs, bench, block_words=words)).collect()
        assert many((r.doc_id, tuple(r)[1:]) for r in got) == many(want)
    assert decontamination.contamination(nothing, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where(F.size("begins") > 0).count() == 0


def test_proximity(spark):
    texts_ = [(1, "alpha " + "soil " * 20 + "alpha beta"), (2, "beta soil soil alpha soil"), (3, "alpha " + "soil " * 12 + "beta"), (4, "beta"), (5, None), (6, "gamma delta"), (6, "delta x gamma")]
    items = [("p", "soil alpha"), ("q", "beta soil"), ("p", "beta soil"), ("r", "gamma soil delta"), ("s", "delta gamma"), ("t", "beta"), (None, "alpha beta")]
    d, b = spark.createDataFrame(texts_, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    for size in (decontamination.BLOCK_WORDS, 1):
        got = many((r._id, sorted((m.item, m.place, m.distance) for m in r.near)) for r in decontamination.contamination(d, b, block_words=size).collect())
        # p has soil, alpha and beta: alpha and beta are rarest; soil and beta of q stand 1 apart in 2 and 3
        assert got[1] == [[("p", 21, 1), ("q", 20, 2)]]
        assert got[2] == [[("p", 0, 3), ("q", 0, 1)]]
        assert got[3] == [[("q", 12, 1)]]
        assert got[4] == got[5] == [[]]
        assert got[6] == sorted([[("r", 0, 1), ("s", 0, 1)], [("r", 0, 2), ("s", 0, 2)]])


def test_cover_tree(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base + 0.05 * k * rng.normal(size=base.shape) for k in range(6)] + [base[:4], base[:2] * 2]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, [], 1), (n + 5, [1.0] * 8, 1), (n + 6, [1.0] * 8, 1), (None, rows[0][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, root int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(frame).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    root = roots(n, lambda i, j: near[i, j])
    for i in range(n):
        assert got[i] == (int(near[i].sum()) - 1, root[i], root[i] == i)
    assert all(got[n + k] == (0, n + k, True) for k in range(5))
    assert got[n + 5] == (1, n + 5, True) and got[n + 6] == (1, n + 5, False)
    assert covertree.near_vectors(frame.limit(0)).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("spread", [0.0, 0.01, 0.05, 0.1, 0.3, 3.0])
def test_cover_tree_traversal_finds_all_pairs(spread):
    rng = np.random.default_rng(4)
    x = unit(np.repeat(rng.normal(size=(40, 8)), 40, 0) + spread * rng.normal(size=(1600, 8)))
    weight = rng.integers(1, 4, len(x))
    near = np.clip(x @ x.T, -1, 1) >= 0.95
    np.fill_diagonal(near, False)
    whole = covertree.Links(x, weight, 0.95)
    whole.nodes(*[covertree.Node(x, np.arange(len(x)))] * 2)
    assert (whole.n == near @ weight).all() and (whole.settle() == roots(len(x), lambda i, j: near[i, j])).all()
    two = covertree.Links(x, weight, 0.95)
    two.nodes(covertree.Node(x, np.arange(900)), covertree.Node(x, np.arange(900, len(x))))
    near[:900, :900] = near[900:, 900:] = False
    assert (two.n == near @ weight).all()


def test_cover_tree_levels():
    rng = np.random.default_rng(5)
    x = unit(np.repeat(rng.normal(size=(30, 8)), 60, 0) + 0.1 * rng.normal(size=(1800, 8)))
    todo, depth = [covertree.Node(x, np.arange(len(x)))], 0
    while todo:
        below = []
        for a in todo:
            few, wide = a.children()
            held = np.concatenate([few, *(c.points for c in wide)])
            assert sorted(held) == sorted(a.points) and covertree.angles(x[a.points], x[a.center]).max() <= a.radius + 1e-9
            if len(a.points) > covertree.FEW:
                centers = np.array([*few, *(c.center for c in wide)])
                assert a.center in centers and all(c.radius <= a.radius / 2 + 1e-7 for c in wide)  # nested, halving
                away = np.arccos(np.clip(x[centers] @ x[centers].T, -1, 1)) + 9 * np.eye(len(centers))
                assert away.min() > a.radius / 2 - 1e-7
            below += wide
        todo, depth = below, depth + 1
    assert depth > 3


def test_cover_tree_prunes_what_is_clustered():
    rng = np.random.default_rng(6)
    for dimension, spread, least, most in ((64, 0.02, 0, 0.02), (64, 1e9, 0.9, 1.0)):  # clusters apart; without clusters nothing can be pruned
        x = unit(np.repeat(rng.normal(size=(100, dimension)), 40, 0) + spread * rng.normal(size=(4000, dimension)))
        found = covertree.Links(x, np.ones(len(x), np.int64), 0.95)
        found.nodes(*[covertree.Node(x, np.arange(len(x)))] * 2)
        assert least <= found.compared / (len(x) * (len(x) - 1) / 2) <= most


def test_cover_tree_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(covertree, "PART", 40 * 12)
    monkeypatch.setattr(covertree, "CELLS", 7)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.repeat(rng.normal(size=(9, 12)), 40, 0) + 0.08 * rng.normal(size=(360, 12)), rng.normal(size=(1, 12)) + 0.02 * rng.normal(size=(300, 12)), rng.normal(size=(700, 12))])
    monkeypatch.setattr(covertree, "max", lambda *a: a[1] if a[0] == 256 else max(*a), raising=False)
    near = unit(x) @ unit(x).T >= 0.95
    root = roots(len(x), lambda i, j: near[i, j])
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(frame).collect()}
    assert all(got[i] == (int(near[i].sum()) - 1, root[i]) for i in range(len(x)))


def test_cover_tree_keeps_double_precision(spark):
    a = 0.95 + 1e-9  # float32 would not tell these from 0.95
    rows = [("a", [1.0, 0.0]), ("b", [a, (1 - a * a) ** 0.5]), ("c", [0.95 - 1e-9, -((1 - (0.95 - 1e-9) ** 2) ** 0.5)]), ("d", [1e300, 0.0]), ("e", [1e-300, 0.0]), ("f", [float("inf"), 1.0]), ("a", [0.0, 1.0]), ("a", [0.0, 1.0])]
    got = many((r.vec_id, (r.n_links, r.component_id)) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect())
    assert got["b"] == [(3, "a")] and got["c"] == [(0, "c")] and got["d"] == got["e"] == [(3, "a")] and got["f"] == [(0, "f")]
    assert got["a"] == [(1, "a"), (1, "a"), (3, "a")]


def lines_left(rows, depth=3, least=4, keep_first=True):
    """line_dedup by loops: {row number: (lines, dropped, kept)}."""
    place, leaf_docs = {}, defaultdict(lambda: defaultdict(set))
    for r, (doc, text) in enumerate(rows):
        for no, line in enumerate((text or "").split("\n") if text is not None and doc is not None else []):
            w = words_of(line)
            t = ["<*>" if re.search("[0-9]", x) else x for x in w]
            if w:
                told = sum(x != "<*>" for x in t) * 10 >= 6 * len(t)
                t = tuple(t if told else w)
                leaf = (len(t), t[:depth] if told else ("=", *t))
                place[r, no] = leaf, t
                leaf_docs[leaf][t].add(doc)
    template, docs = {}, defaultdict(set)
    for leaf, lines_ in leaf_docs.items():
        for t in lines_:
            shape = tuple(x if x != "<*>" and sum(len(d) for u, d in lines_.items() if u[k] == x) >= least else "<*>" for k, x in enumerate(t))
            fixed = sum(x != "<*>" for x in shape) * 10 >= 6 * len(t)
            template[leaf, t] = (leaf, "T", shape) if fixed and len(lines_) > 1 else (leaf, "L", t)
    for leaf, lines_ in leaf_docs.items():
        for t, d in lines_.items():
            docs[template[leaf, t]] |= d
    out = {}
    for r, (doc, text) in enumerate(rows):
        ls = text.split("\n") if text is not None else []
        gone = {no for no in range(len(ls)) if (r, no) in place and len(x := docs[template[place[r, no]]]) >= least and (doc > min(x) or not keep_first)}
        out[r] = len(ls), len(gone), None if text is None else "\n".join(x for no, x in enumerate(ls) if no not in gone)
    return out


def test_lines(spark, nothing):
    rng = random.Random(21)
    rows = [(i, f"user {i} logged in from host{i} today\nan own line number {'abcdefghij'[i]} stands here alone {'xyzuvwrstq'[i]}\nshort one\n1 2 {i}\n17 4\n") for i in range(10)]
    rows += [(20, None), (21, ""), (None, rows[0][1]), (3, rows[3][1]), (4, "another text\nunder a used id\nshort one"), (22, "\n\n \t\n"), (23, "<*> here\n= 1 2")]
    vocabulary = ["all", "rights", "reserved", "by", "2024", "x1", "the", "=", "漢字", "a" * 5000]
    for i in range(30, 70):
        rows.append((i, "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 12)))))
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, keys int, lines int").repartition(3)
    for first in (True, False):
        want = many((r[0], v) for r, v in zip(rows, lines_left(rows, keep_first=first).values()))
        assert many((r.doc_id, (r._n_lines, r._n_dropped, r._kept)) for r in lines.line_dedup(frame, keep_first=first).collect()) == want
    assert lines.line_dedup(nothing).count() == 0


def test_lines_with_very_long_words(spark):
    rows = [(i, f"{'x' * 1_000_000}\n{'字' * 300_000}{i}\n" + "one line\n" * 20_000) for i in range(5)]
    begun = time.time()
    got = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert time.time() - begun < 60
    assert got[0]._n_dropped == 0 and all(got[i]._n_dropped == 20_001 and got[i]._kept == f"{'字' * 300_000}{i}\n" for i in range(1, 5))


def test_lines_split_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)  # a key with more than a fifth of all rows is hot
    rng = random.Random(22)
    rows = [(i, "\n".join(["the same line of all"] + [" ".join(["every line begins", *(rng.choice("ab") for _ in range(4))]) for _ in range(3)])) for i in range(40)]
    want = many((r[0], v) for r, v in zip(rows, lines_left(rows).values()))
    assert many((r.doc_id, (r._n_lines, r._n_dropped, r._kept)) for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == want


def test_language(spark, docs, nothing):
    french, english = "le chat est sur la table avec les enfants", "the cat is on the table with all the children"
    train = spark.createDataFrame([(f"{t} {t}", c) for t, c in ((french, "fr"), (english, "en")) for _ in range(5)] + [(None, "fr"), ("x", None)], "text string, lang string")
    pages = [(1, "http://a.fr/x", f"<html lang='fr'><p>{french}</p></html>"), (2, "http://b.uk/", f"<html lang=en><script>le la les</script>{english}"), (3, None, None), (4, "http://a.fr/y", ""), (5, "http://a.fr/z", "<p>123 ###</p>"), (2, "http://b.uk/", english), (6, "bad url", "<html lang='fr'>" + english)]
    got = many((r.page_id, (r.lang, r.accepted)) for r in language.identify_pages(spark.createDataFrame(pages, "page_id int, url string, html string"), train).collect())
    assert got[1] == [("fr", True)] and got[2] == [("en", True)] * 2 and got[6] == [("en", True)]
    assert not any(a for k in (3, 4, 5) for _, a in got[k])
    assert language.identify_pages(spark.createDataFrame([], "page_id int, url string, html string"), train).count() == 0
    kept = language.accepted_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(60)) and not {60, 61, 62} & {r.doc_id for r in kept.collect()}
    assert language.accepted_documents(nothing).count() == 0


def test_visible_text():
    page = "a<!-- x > y -->b<script type=x>if (a<b) </scripty>c</SCRIPT >d<style>e</style>f<HTML xml:x lang = 'FR'>g&amp;h<br/>i<html lang=en>"
    text, lang = language.visible(page)
    assert text.split() == ["a", "b", "d", "f", "g&h", "i"] and lang == "fr"
    assert language.visible("<script>open <b>x</b>") == (" open  x ", None) and language.visible("a < b") == ("a < b", None) and language.visible("<!-- open > z") == ("  z", None)


@pytest.mark.parametrize("page", ["<" * 2_000_000, "<script>" * 300_000, "<html " * 300_000, "<!--" * 500_000, "<!-- -->" * 200_000, "</script " * 200_000, "<script>" + "</script " * 200_000, "<html lang" + " " * 1_000_000 + ">", "&" * 1_000_000, "<style>x</style" + " " * 1_000_000])
def test_hostile_pages_are_read_once(page):
    begun = time.time()
    language.visible(page)
    assert time.time() - begun < 5


def test_posterior_by_hand(spark):
    """Fusion in plain Python loops, of given text likelihoods."""
    rng, n = random.Random(31), 3
    rows = []
    for i in range(200):
        logs = [rng.uniform(-9, 0) for _ in range(n)]
        host = rng.choice(["", "a.x.fr", "b.x.fr", "c.de", "big.com", "big.com", "big.com"])
        rows.append((i % 190, rng.choice(["", "fr", "de"]), host, ".".join(host.split(".")[-2:]), host.split(".")[-1], logs, rng.choice([0, 5, 50])))
    votes = [max(range(n), key=lambda k: r[5][k]) if r[6] else None for r in rows]

    def v(at, value, k):
        return sum(x == k for r, x in zip(rows, votes) if at is None or r[at] == value)

    want = []
    for r, own in zip(rows, votes):
        post = []
        for k in range(n):
            me, any_vote = float(own == k), float(own is not None)
            total = sum(v(None, None, j) for j in range(n))
            share = language.UNKNOWN_SHARE if k == n - 1 else (1 - language.UNKNOWN_SHARE) / (n - 1)
            p = (v(None, None, k) - me + 5 * share) / (total - any_vote + 5)
            for at in (3, 2):
                if r[at]:
                    p = (v(at, r[at], k) - me + 5 * p) / (sum(v(at, r[at], j) for j in range(n)) - any_vote + 5)
            said = [(v_and(rows, votes, at, r[at], k) - me + 0.5) / (v(None, None, k) - me + 10) if r[at] else 1.0 for at in (1, 4)]
            post.append(r[5][k] + np.log(max(p, 1e-9)) + np.log(said[0]) + np.log(said[1]))
        e = np.exp(np.array(post) - max(post))
        want.append((r[0], ("xyz"[int(np.argmax(post))], round(float(e.max() / e.sum()), 9))))
    frame = spark.createDataFrame(rows, "_id int, _declared string, _host string, _domain string, _suffix string, _logs array<double>, _grams bigint").repartition(3)
    for hot in (1000, 3):
        language.HOT, before = hot, language.HOT
        got = language.fuse(frame, list("xyz")).collect()
        language.HOT = before
        assert many((g._id, (g._lang, round(g._probability, 9))) for g in got) == many(want)


def v_and(rows, votes, at, value, k):
    return sum(r[at] == value and x == k for r, x in zip(rows, votes))


def test_lattice_against_every_path():
    rng = np.random.default_rng(9)
    channel = toxicity.Channel(toxicity.log_probabilities(rng.integers(0, 50, (toxicity.SYMBOLS,) * 3)))

    def every(lattice):
        paths = [(0.0, (0, 0), "")]
        for options in lattice:
            paths = [(s - c, (a, b), t) if k is None else (s + channel.logs[a][b][k] - c, (b, k), t + x) for s, (a, b), t in paths for k, c, x in options]
        return max((s + channel.logs[a][b][0], t) for s, (a, b), t in paths)

    for word in ["1d10t", "mmmoron", "$c|_|m", "b1@!", "aaa", "0", "i777", "x--y", "9gg9", "é1l"]:
        assert channel.restore(word) == every(list(channel.choices(word)))[1]
    for letters in ["idiot", "amor0n", "1d1ot", "ab"]:
        assert " ".join(channel.restore_spaced(letters)) == " ".join(every(list(channel.spaced(letters)))[1].split())


def test_spaced_words_are_parted_by_the_model():
    text = "you are a moron and an idiot " * 400
    s = np.concatenate([[0, 0], toxicity.SYMBOL[np.frombuffer(text.encode(), np.uint8)], [0]])
    counts = np.bincount((s[:-2] * toxicity.SYMBOLS + s[1:-1]) * toxicity.SYMBOLS + s[2:], minlength=toxicity.SYMBOLS**3).reshape((toxicity.SYMBOLS,) * 3)
    channel = toxicity.Channel(toxicity.log_probabilities(counts))
    assert channel.restore_spaced("youaream0r0n") == ["you", "are", "a", "moron"]
    assert toxicity.Restorer(channel).words("so y o u a r e a n 1 d i o t.")[-3:] == ["you", "are", "idiot"]


def test_toxicity_of_long_and_repeated_texts(spark):
    rows = [(i, "the soil idiot " + "x" * 50_000 if i % 2 else "the soil " + "wa1ter " * 20_000, "c") for i in range(12)] + [(3, "the soil idiot", "c")] * 2 + [(20, "i d i o t " * 5_000, "c"), (21, "1" * 100_000 + "a", "c")]
    labels = [(i, i % 2) for i in range(12)]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id int, text string, _text string"), spark.createDataFrame(labels, "doc_id int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_mixing_with_odd_weights(spark):
    rows = [(i, "word " * (i % 7), f"s{i % 2}", q) for i in range(40) for q in [None, float("nan"), float("inf"), -1.0, 0.0, 3.0]]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string, q double"), quality=F.col("q")).collect()
    assert len(out) == len(rows) and sum(r._taken for r in out) > 0.99 * sum(r._size for r in out) and all(0 <= r._taken <= 3 * r._size for r in out)


def test_toxicity(spark, nothing):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, 40).split()
        bad = i % 4 == 0
        if bad:
            w.insert(rng.randint(0, 40), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(w), i))
        labels.append((i, int(bad)))
    rows += [(1000, "you 1d10t said the farm", 0), (1001, "such a m o r o n in the field", 0), (1002, "the sccccum of the soil", 0), (1003, None, 0), (1004, "", 0), (None, "the idiot", 0), (1005, "soil and water", 0)]
    labels += [(3, None), (5, 1), (99999, 1)]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    assert all(got[i].predicted == 1 for i in (1000, 1001, 1002, None)) and all(got[i].predicted == 0 for i in (1003, 1004, 1005))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(400)) and not got[None].held_out
    assert toxicity.toxicity(nothing, spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 0


def test_pipeline(spark, docs, rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, rows[9][1])], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        d = common.saved(stage(spark, d, sf), name)
        seen[name] = d
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_output"]
    assert all(seen[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in list(seen)[:-1])
    ids = {n: [r.doc_id for r in x.select("doc_id").collect()] for n, x in seen.items()}
    assert 61 not in ids["language"] and 63 not in ids["near_duplicates"] and 5 in ids["near_duplicates"] and 9 not in ids["decontamination"]
    assert len(ids["token_output"]) == len(ids["mixing"])
    assert len(pipeline.run(spark, sf).collect()) == len(ids["token_output"])
