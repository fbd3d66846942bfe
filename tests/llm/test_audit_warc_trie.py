"""Filter audit, chunked archives and the prefix trie against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioframe.llm import audit, packing, trie, warc

DOCS = "doc_id bigint, text string, source string, part string, bits int, mask int, n int"


def audited(rows, labels):
    texts = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            texts[t or ""].append(i)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    failed = []
    for i, t, s, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > min(texts[t]))
        failed.append((s or "", {x for x, f in zip("ABCDE", fails) if f}, i in good and i is not None, i in toxic and i is not None))
    want = Counter()
    keys = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for part, order in itertools.product({f[0] for f in failed}, itertools.permutations("ABCDE")):
        for step, x in enumerate(order, 1):
            for k in keys:
                want[part, "".join(order), step, k] += 0
    for part, f, g, x in failed:
        for order in itertools.permutations("ABCDE"):
            there = True
            for step, letter in enumerate(order, 1):
                at = (part, "".join(order), step)
                fails, was = letter in f, there
                there = there and not fails
                want[(*at, "kept")] += there
                want[(*at, "removed")] += was and fails
                want[(*at, "redundant")] += fails and not was
                want[(*at, "unique_fails")] += f == {letter}
                want[(*at, "good_lost")] += was and fails and g
                want[(*at, "toxic_lost")] += was and fails and x
    by = Counter()
    for (p, o, s, k), v in want.items():
        if k == "removed":
            by[p, o[s - 1]] += v
    return {(p, o, s): tuple(want[p, o, s, k] for k in keys) + (by[p, o[s - 1]],) for p, o, s, k in want if k == "kept"}


def test_filter_audit(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(80)] + ["SOIL", "a|b", "é"]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 80, 83])]) for _ in range(rng.choice([0, 3, 49, 50, 90]))) for _ in range(12)] + ["", None, " \t\n", "x" * 3000]
    rows = [(rng.choice([*range(60), None]), rng.choice(texts), rng.choice(["a", "a", "a", "b", "", None]), "x", 1, 2, 3) for _ in range(90)]
    rows += [(5, texts[4], "a", "x", 1, 2, 3)] * 3  # one row, repeated
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(40)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(audit.cells(docs, marks)).collect()}
    want = audited(rows, labels)
    assert len(got) == 600 * 3 and got == want
    assert audit.audit(audit.cells(docs.limit(0), marks)).count() == 0
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(audit.cells(docs, marks.limit(0))).collect()} == audited(rows, [])


def read_plainly(data):
    """(fields, payload) of each record of a WARC file."""
    out = []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        block, data = data[:n], data[n:]
        assert data[:4] == b"\r\n\r\n"
        out.append((fields, block.split(b"\r\n\r\n", 1)[1]))
        data = data[4:]
    return out


@pytest.fixture(scope="module")
def pages(spark):
    long, umlaut = "<p>" + "soil water " * 400 + "\r\n\r\n</p>", "é漢" * 700
    rows = [(1, "https://a/x y\r\nWARC-Type: evil", long), (2, None, long), (9, "u", long), (3, "u", umlaut), (4, "u", umlaut), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", long), (None, "u", "x" * 1000), (9, "u", long), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "z" * 1000)]
    return rows, spark.createDataFrame([(*r, "k", 1, b"d") for r in rows], "page_id bigint, url string, html string, keeper string, chunk int, data binary").repartition(3)


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_archives(spark, pages, chunk):
    rows, frame = pages
    table = warc.archived(frame, chunk=chunk)
    assert table.where(F.length("data") > chunk + 2000).count() == 0
    files = defaultdict(bytes)
    for r in table.orderBy("archive", "record", "chunk").collect():
        files[r.archive] += bytes(r.data)
    found = [x for f in files.values() for x in read_plainly(f)]
    assert len(found) == len(rows) and sum(f["WARC-Type"] == "revisit" for f, _ in found) == 4
    for fields, payload in found:
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
    got = Counter(tuple(r) for r in warc.resolved(warc.records(table)).select("page", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for i, _, html in rows:
        p = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == p and j is not None]
        again = len(p) >= 1000 and same and i != max(same)
        want[None if i is None else str(i), len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", str(max(same)) if again else None] += 1
    assert got == want


def test_archives_of_nothing_and_damage(spark, pages):
    frame = pages[1]
    assert warc.resolved(warc.records(warc.archived(frame.limit(0)))).count() == 0
    table = warc.archived(frame, chunk=50)
    for broken in (table.where("not (record = 0 and chunk = 1)"), table.withColumn("data", F.when(F.col("chunk") == 1, F.concat(F.substring("data", 2, 100), F.lit(b"!"))).otherwise(F.col("data"))), table.withColumn("digest", F.lit("0"))):
        with pytest.raises(Exception, match="record"):
            warc.records(broken).collect()


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            d = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), d, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def grown(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = {q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p}
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under) for q in under)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [1, 3, 4096])
def test_trie(spark, shards):
    rng = random.Random(11)
    turn = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["soil", "water é", "", None, "x" * 500]))
    opening = [("user", "hello"), ("assistant", "how can I help?")]
    rows = []
    for c in [*range(60), 1001, 2003, 10**12]:
        talk = (opening if rng.random() < 0.6 else []) + [turn() for _ in range(rng.choice([0, 1, 2, 12]))]
        rows += [(c, rng.choice([k, k, None]), *t) for k, t in enumerate(talk)]
    rows += [(61, 0, "user", "a"), (61, 0, "user", "b"), (61, 0, "user", "a"), (61, None, None, None), (None, 1, "user", "lost"), (700, None, None, None)]
    rows += [(800, k, "user", f"t{k}") for k in range(150)] + [(801, k, "user", f"t{k}") for k in range(150)]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, path string").repartition(3)
    got = sorted((tuple(r) for r in trie.trie(frame, shards=shards).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)
    assert got == grown(rebuilt(rows))
    assert trie.trie(frame.limit(0)).count() == 0


def test_queue_spills():
    rng = random.Random(2)
    q, want = trie.Queue(held=5), []
    for _ in range(400):
        for _ in range(rng.randint(0, 9)):
            m = (rng.randint(-9, 0), bytes([rng.randint(0, 9)]), rng.randint(0, 99), 1)
            q.push(m)
            want.append(m)
        want.sort()
        for _ in range(min(len(want), rng.randint(0, 9))):
            assert q.least() == want[0] == q.pop()
            want.pop(0)
    assert [q.pop() for _ in want] == want and q.least() is None


def test_ends_over_many_ranges(spark):
    ids = [(b"x" * 16, i * 7 - 200) for i in range(300)] + [(b"y" * 16, 5)]
    got = {bytes(r[0]): r[1] for r in trie.ends(spark.createDataFrame(ids, "path binary, conv_id long").repartition(3)).collect()}
    assert got == {p: hashlib.sha256(",".join(str(c) for q, c in sorted(ids) if q == p).encode()).hexdigest() for p in (b"x" * 16, b"y" * 16)}


@pytest.mark.parametrize("kind", ["smallint", "date", "decimal(12,2)", "string"])
def test_packed_ids_of_any_type(spark, kind):
    """Ids come back as they were, whatever their type; nulls first."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.range(4).select(F.when(F.col("id") > 0, F.expr("date_add(date'2024-01-01', int(id))") if kind == "date" else F.col("id")).cast(kind).alias("doc_id"), F.concat(F.lit("soil "), F.col("id").cast("string")).alias("text"))
    got = packing.packed_digest(docs, path).orderBy("start").collect()
    want = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    assert [r.doc_id for r in got] == want and got[0].doc_id is None
