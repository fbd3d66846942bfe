"""Benchmark decontamination over a distributed positional inverted index (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, mapped, saved, texts

WINDOW = 10
#: Two rarest terms of an item within so many words count as a proximity match.
NEAR = 10
#: Words of benchmark text that go out to the executors at once; more is searched in further passes.
BLOCK_WORDS = 1_000_000
#: Words of training text in one shard of the index, at least one document.
SHARD_WORDS = 1 << 19
#: Candidate places met with the other lists at once.
STRIP = 1 << 18

#: Upper-case ASCII to lower case, other ASCII but letters and digits to a space; the rest stays.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class TestTerms:
    """One block of the benchmark in flat arrays: its terms, its distinct windows, and which items hold them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.term: dict[bytes, int] = {}
        self.window = window
        names: dict[str, int] = {}
        rows, owners, held, holder = [], [], [], []
        for item, text in items:
            ids = np.array([self.term.setdefault(w, len(self.term)) for w in words(text)], np.int32)
            if not len(ids):
                continue
            who = -1 if item is None else names.setdefault(item, len(names))
            if len(ids) < window:
                found = np.full((1, window), -1, np.int32)
                found[0, : len(ids)] = ids
            else:
                found = np.lib.stride_tricks.sliding_window_view(ids, window)
            rows.append(found)
            owners.append(np.full(len(found), who, np.int64))
            held.append(np.unique(ids))
            holder.append(np.full(len(held[-1]), who, np.int64))
        self.names = list(names)
        none = np.empty(0, np.int64)
        self.terms, at = np.unique(np.concatenate(rows), axis=0, return_inverse=True) if rows else (np.empty((0, window), np.int32), none)
        self.size = (self.terms >= 0).sum(1)
        # Items by window, each once; rows without an id mark words and are not listed.
        owner = np.concatenate([*owners, none])
        pairs = np.unique(np.stack([at.ravel()[owner >= 0], owner[owner >= 0]]), axis=1)
        self.items, self.item_bounds = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.terms) + 1))
        self.held = np.unique(np.stack([np.concatenate([*holder, none]), np.concatenate([*held, none])]), axis=1)

    def plan(self, frequency: np.ndarray) -> None:
        """Orders each window's places from the rarest term on, windows by their rarest term, and finds each item's two rarest terms."""
        often = np.where(self.terms >= 0, frequency[np.maximum(self.terms, 0)] if len(frequency) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(often, axis=1, kind="stable").astype(np.int32)
        rarest = self.terms[np.arange(len(self.terms)), self.order[:, 0]]
        self.by_term = np.argsort(rarest, kind="stable")
        self.rarest = rarest
        item, term = self.held[:, self.held[0] >= 0]
        order = np.lexsort((term, frequency[term] if len(term) else term, item))
        item, term = item[order], term[order]
        first = np.nonzero(np.diff(item, prepend=-1))[0]
        first = first[np.diff(np.append(first, len(item))) > 1]
        self.near = np.stack([term[first], term[first + 1], item[first]], axis=1) if len(first) else np.empty((0, 3), np.int64)

    def search_part(self) -> TestTerms:
        """What a search needs: all but the words."""
        out = object.__new__(TestTerms)
        out.__dict__ |= {k: v for k, v in self.__dict__.items() if k not in ("term", "held")}
        return out


class Shard:
    """Positional postings of some documents: for each test term its places in ascending order, as one sorted list of (term, place)."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, n_terms: int):
        self.ends, self.places = ends.astype(np.int64), places.astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.counts = np.zeros(n_terms, np.int64)
        self.counts[terms] = counts
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.postings = np.repeat(np.arange(n_terms, dtype=np.int64), self.counts) << 32 | self.places
        self.doc = np.searchsorted(self.ends, self.places, "right")

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is in its term's list."""
        key = term.astype(np.int64) << 32 | place
        k = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return self.postings[k] == key

    def phrases(self, test: TestTerms) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, begins) of all occurrences: the rarest term's list, less its offset, meets the other lists, rarer ones first.

        Windows with a term that the shard lacks go at once. Occurrences never cross the end of a document.
        """
        if not len(self.postings):
            return
        whole = ((test.terms < 0) | (self.counts[np.maximum(test.terms, 0)] > 0)).all(1)
        windows = test.by_term[whole[test.by_term]]
        size = self.counts[test.rarest[windows]]
        upto = np.cumsum(size)
        i = 0
        while i < len(windows):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STRIP, "right")))
            win = np.repeat(windows[i:j], size[i:j])
            inside = np.arange(len(win)) - np.repeat(np.cumsum(size[i:j]) - size[i:j], size[i:j])
            k = self.bounds[test.rarest[win]] + inside
            at, doc = self.places[k] - test.order[win, 0], self.doc[k]
            ok = (at >= self.begins[doc]) & (at + test.size[win] <= self.ends[doc])
            win, at = win[ok], at[ok]
            for n in range(1, test.window):
                if not len(win):
                    break
                offset = test.order[win, n]
                ok = n >= test.size[win]
                ok[~ok] = self.holds(test.terms[win, offset][~ok], (at + offset)[~ok])
                win, at = win[ok], at[ok]
            if len(win):
                yield win, at
            i = j

    def near(self, test: TestTerms, distance: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(documents, item, places, distances): where an item's two rarest terms stand closest in a document, if within `distance` words."""
        for a, b, item in test.near.tolist():
            p, q = (slice(self.bounds[t], self.bounds[t + 1]) for t in (a, b))
            p, doc, q = self.places[p], self.doc[p], self.places[q]
            if not len(p) or not len(q):
                continue
            k = np.searchsorted(q, p)
            best, other = np.full(len(p), distance), p
            for j in (k - 1, k):
                o = q[np.clip(j, 0, len(q) - 1)]
                inside = (o >= self.begins[doc]) & (o < self.ends[doc])
                closer = inside & (np.abs(o - p) < best)
                best, other = np.where(closer, np.abs(o - p), best), np.where(closer, o, other)
            hit = np.nonzero(best < distance)[0]
            hit = hit[np.lexsort((p[hit], best[hit], doc[hit]))]
            hit = hit[np.diff(doc[hit], prepend=-1) > 0]
            if len(hit):
                yield doc[hit], item, np.minimum(p, other)[hit] - self.begins[doc[hit]], best[hit]


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[TestTerms]:
    """The benchmark's rows with words in blocks of about `most` words, all rows of an id in one; the driver holds one block at a time."""
    out: list[tuple[str | None, bytes]] = []
    size = 0
    frame = items.select(F.col(id_col).cast("string").alias("_item"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    for r in frame.orderBy("_item").toLocalIterator():
        text = r[1].encode()
        if out and size + len(text) > 6 * most and r[0] != out[-1][0]:
            yield TestTerms(out, window)
            out, size = [], 0
        out.append((r[0], text))
        size += len(text)
    if out:
        yield TestTerms(out, window)


def positional_index(docs: DataFrame, test: TestTerms, id_col: str, text_col: str) -> DataFrame:
    """The stored index: one row a shard of documents (ids, text hashes, ends) with the postings of the test's terms.

    terms, counts and places are 32-bit little-endian numbers: the terms that stand in the shard, how
    often, and their places term by term. Only Spark's writer and reader touch it, so it lies where all
    executors reach it and is read shard by shard.
    """
    sent = docs.sparkSession.sparkContext.broadcast(test.term)
    frame = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_tid"), F.col(text_col).cast("string").alias("_text"))
    kind = frame.schema["_id"].dataType.simpleString()
    names = ["ids", "tids", "ends", "terms", "counts", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        ids, tids, found, n = [], [], [], 0

        def row(kind: pa.DataType) -> pa.RecordBatch:
            flat = np.concatenate(found)
            known = np.nonzero(flat >= 0)[0]
            order = known[np.argsort(flat[known], kind="stable")].astype("<i4")
            terms, counts = np.unique(flat[known], return_counts=True)
            packed = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (terms, counts, order)]
            ends = np.cumsum([len(f) for f in found])
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([tids], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int32())), *packed], names)

        for b in batches:
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
                w = words(text)
                ids.append(i)
                tids.append(t)
                found.append(np.fromiter((get(x, -1) for x in w), np.int32, len(w)))
                n += len(w)
                if n >= SHARD_WORDS:
                    yield row(b.schema.field(0).type)
                    ids, tids, found, n = [], [], [], 0
        if ids:
            yield row(b.schema.field(0).type)

    return mapped(frame, run, f"ids array<{kind}>, tids array<bigint>, ends array<int>, terms binary, counts binary, places binary")


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often each test term stands in the whole corpus, from the index; a task sends one row a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for b in batches:
            for terms, counts in zip(b.column(0), b.column(1)):
                n[np.frombuffer(terms.as_buffer(), "<i4")] += np.frombuffer(counts.as_buffer(), "<i4")
        k = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], ["term", "n"])

    found = mapped(index.select("terms", "counts"), count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def search(index: DataFrame, test: TestTerms, near: int = NEAR) -> DataFrame:
    """Per document of the index: _id, _tid, n_words, the runs of words inside occurrences (begins, ends), item ids, near."""
    n_terms = len(test.term)
    sent = index.sparkSession.sparkContext.broadcast(test.search_part())
    kind = index.schema["ids"].dataType.elementType.simpleString()
    longs, places = pa.list_(pa.int64()), pa.list_(pa.struct([("item", pa.string()), ("place", pa.int64()), ("distance", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield one([b.column(i)[k] for i in range(6)], sent.value)

    def one(row: list[pa.Scalar], test: TestTerms) -> pa.RecordBatch:
        numbers = [np.frombuffer(x.as_buffer(), "<i4") for x in row[3:]]
        s = Shard(row[2].values.to_numpy(), *numbers, n_terms)
        n = len(s.ends)
        depth = np.zeros((s.ends[-1] if n else 0) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(n)]
        for win, at in s.phrases(test):
            np.add.at(depth, at, 1)
            np.add.at(depth, at + test.size[win], -1)
            hits = np.unique(np.stack([np.searchsorted(s.ends, at, "right"), win]), axis=1)
            for d, w in hits.T.tolist():
                items[d].update(test.items[test.item_bounds[w] : test.item_bounds[w + 1]].tolist())
        hit = np.concatenate([np.cumsum(depth[:-1]) > 0, [False]])
        begins, ends = [[] for _ in range(n)], [[] for _ in range(n)]
        for d in np.unique(np.searchsorted(s.ends, np.nonzero(hit)[0], "right")).tolist():
            edge = np.diff(np.concatenate([[0], hit[s.begins[d] : s.ends[d]].view(np.int8), [0]]))
            begins[d], ends[d] = np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()
        close: list[list] = [[] for _ in range(n)]
        for doc, item, place, away in s.near(test, near):
            for d, p, x in zip(doc.tolist(), place.tolist(), away.tolist()):
                close[d].append((test.names[item], p, x))
        names = [sorted(test.names[i] for i in x) for x in items]
        return pa.RecordBatch.from_arrays(
            [row[0].values, row[1].values, pa.array(s.ends - s.begins, pa.int64()), pa.array(begins, longs), pa.array(ends, longs), pa.array(names, pa.list_(pa.string())), pa.array(close, places)],
            ["_id", "_tid", "n_words", "begins", "ends", "items", "near"],
        )

    schema = f"_id {kind}, _tid bigint, n_words bigint, begins array<bigint>, ends array<bigint>, items array<string>, near array<struct<item:string,place:bigint,distance:bigint>>"
    return mapped(index.select("ids", "tids", "ends", "terms", "counts", "places"), run, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per row of docs: _id, _tid (xxhash64 of the text), n_words, begins, ends, items, near.

    begins and ends are the runs of words inside any occurrence of a benchmark window (word numbers
    from 0, end excluded); items are the ids, as strings, of the items with occurring windows; near has,
    for each item whose two rarest words stand within `near` words of each other, the item, the place of
    the first of the two where they are closest, and how far apart they are.

    The training texts are read once into an index of positional postings that is stored by shards; it
    holds the benchmark's terms, because no other term is ever looked up. Corpus-wide term counts come
    from it, and each window then starts from its rarest term's list. The benchmark goes out in blocks
    of bounded size; of more than one block each has its index, and the results meet by id and text.
    Null texts have no words; items without words have no windows; an item with a null id marks words
    but is not listed; rows of items with one id are one item; documents with equal ids stay apart as
    rows; extra columns are ignored; an empty benchmark hits nothing; an empty table gives no rows.
    """

    def found(test: TestTerms) -> DataFrame:
        index = saved(positional_index(docs, test, id_col, text_col), "index")
        test.plan(term_counts(index, len(test.term)) if len(test.term) else np.zeros(0, np.int64))
        out = saved(search(index, test, near), "found")
        dropped(index)
        return out

    parts = blocks(benchmark, item_col, item_text, window, block_words)
    first = found(next(parts, None) or TestTerms([], window))
    several = first
    for test in parts:
        several = several.unionByName(found(test))
    if several is first:
        return first
    # Rows with one id and text have one result; runs of several blocks may overlap: they are joined from left to right.
    spans = F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))
    merged = several.groupBy("_id", "_tid").agg(F.any_value("n_words").alias("n_words"), F.array_sort(F.array_distinct(spans)).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    empty = F.array().cast("array<struct<begins:bigint,ends:bigint>>")

    def join(done, x):
        last = F.element_at(done, -1)
        grown = F.struct(last["begins"].alias("begins"), F.greatest(last["ends"], x["ends"]).alias("ends"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["ends"] >= x["begins"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    runs = F.aggregate("s", empty, join)
    merged = merged.withColumn("r", runs).select(F.col("_id").alias("_one"), F.col("_tid").alias("_text_id"), "n_words", F.transform("r", lambda x: x["begins"]).alias("begins"), F.transform("r", lambda x: x["ends"]).alias("ends"), "items", "near")
    rows = first.select("_id", "_tid")
    return rows.join(merged, F.col("_id").eqNullSafe(F.col("_one")) & (F.col("_tid") == F.col("_text_id"))).drop("_one", "_text_id")


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate(F.zip_with("ends", "begins", lambda e, b: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, starts.n, item_id FROM starts JOIN win USING (n, phrase)
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
