"""Substring dedup with suffix automata of reference shards (operator 3)."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, mapped, saved, spread_join, texts

WINDOW = 13
#: Words of the pieces whose least hash routes a window: equal windows have the same least hash. A crowded
#: shard is dealt anew by the next longer ones, at last by whole windows, of which a shard then holds one.
PIECES = 5, 10
#: A span's name: two signed numbers of 64 bits.
NAME = ">qq"
#: Word hashes that a worker keeps.
KEPT = 500_000
#: Distinct spans beyond which a shard is dealt anew by longer pieces.
CROWDED = 5000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT:
            self[word] = h
        return h


@lru_cache(maxsize=1)
def hashes() -> _Hashes:
    return _Hashes()


def routes(words: list[bytes], window: int, piece: int = PIECES[0]) -> np.ndarray:
    """The route of each window: the least hash among its pieces."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes().__getitem__, words), np.uint64, len(words))
    size = min(piece, window)
    mixed = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(mixed)]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    wide, low = window - size + 1, mixed
    have = 1
    while have < wide:  # the least of `have` neighbours from here on
        step = min(have, wide - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low[:n]


def runs(route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of maximal stretches of windows with one route."""
    cuts = np.nonzero(route[1:] != route[:-1])[0] + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(route)]])


class SuffixAutomaton:
    """All substrings of the sequences put into it, with symbols of any hashable kind."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _new(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, symbol, q: int) -> int:
        """The state of p's longest string and symbol, parted from q."""
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, symbol) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, symbol, q)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p != -1 and symbol not in self.next[p]:
            self.next[p][symbol] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][symbol]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, symbol, q)
        return cur

    def matching(self, sequence: list) -> list[int]:
        """Matching statistics: length of the longest known substring that ends at each place."""
        out, state, n = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (q := self.next[state].get(symbol)) is not None:
                state, n = q, n + 1
            out.append(n)
        return out


def earlier_windows(automaton: SuffixAutomaton, words: list[bytes], window: int) -> list[int]:
    """Begins of the windows of words that the automaton holds."""
    return [k - window + 1 for k, n in enumerate(automaton.matching(words)) if n >= window]


def covered_runs(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _row, begin, end): runs of words inside windows that a document with a smaller id has too.

    1. Each window is routed by the least hash of its pieces, so that all copies of a window have one
       route; a document has one route for about five words. Grouped minimum and maximum of the
       documents' ids show which routes several documents share.
    2. Only stretches of windows with shared routes leave their document, as spans of words. Equal
       spans are counted once, under their first document: any later document with that span has all
       its windows from there.
    3. A route's distinct spans form a reference shard. Its suffix automaton takes them in ascending
       first document; matching statistics of 13 and more show a span's windows that came before.
    A span that a third of all documents share is one row after step 2; a route with many different
    spans is divided by longer pieces, as often as it takes, and an automaton takes only what it doesn't
    hold yet. No shard is broadcast: spans go to the shard that can hold their windows, and to no other.
    Spans are named by 128 bits of hash. Keys of joins that many rows share are known by then and spread.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(id_col, text_col).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    frame = frame.where(F.col("_doc").isNotNull() & F.col("_text").isNotNull())
    kind = frame.schema["_doc"].dataType.simpleString()
    route_kind = pa.list_(pa.int64())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(routes(x.split(), window)).view(np.int64) for x in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, route_kind)], ["_doc", "_row", "_routes"])

    routed = saved(mapped(frame, route, f"_doc {kind}, _row bigint, _routes array<bigint>"), "routes")
    each = routed.select("_doc", "_row", F.explode("_routes").alias("route"))
    shared = each.groupBy("route").agg(F.min("_doc").alias("low"), F.max("_doc").alias("high"), F.count("*").alias("n")).where("low < high").select("route", "n")
    total = routed.agg(F.coalesce(F.sum(F.size("_routes")), F.lit(0))).first()[0]
    wanted = saved(spread_join(each, shared, ["route"], "n", total).groupBy("_doc", "_row").agg(F.collect_set("route").alias("_wanted")), "wanted")
    dropped(routed)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_doc", "_row", "route", "span", "more", "begin", "end", "words"]
        for b in batches:
            kinds = b.schema.field(0).type, *[pa.int64()] * 6, pa.binary()
            out: list[list] = [[] for _ in names]
            size = 0
            for doc, row, text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3)):
                words = text.split()
                r = routes(words, window).view(np.int64)
                first, last = runs(r)
                keep = np.isin(r[first], np.asarray(want.values))
                for x, y in zip(first[keep].tolist(), last[keep].tolist()):
                    y += window - 1
                    piece = b" ".join(words[x:y])
                    size += len(piece)
                    for column, value in zip(out, (doc, row, int(r[x]), *struct.unpack(NAME, xxhash.xxh3_128_digest(piece)), x, y, piece)):
                        column.append(value)
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out, size = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    joined = frame.join(wanted, ["_doc", "_row"]).select("_doc", "_row", "_text", "_wanted")
    found = saved(mapped(joined, spans, f"_doc {kind}, _row bigint, route bigint, span bigint, more bigint, begin bigint, end bigint, words binary"), "spans")
    dropped(wanted)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads shards from sorted rows (shard, first document, span, more, at, words), one after the other."""
        names, kinds = ["span", "more", "earlier"], (pa.int64(), pa.int64(), pa.list_(pa.int32()))
        automaton, shard, first = SuffixAutomaton(), None, None
        waiting: list[list[bytes]] = []
        for b in batches:
            out: list[list] = [[], [], []]
            for key, doc, span, more, at, words in zip(*(c.to_pylist() for c in b.columns)):
                words = words.split()
                if key != shard:
                    automaton, shard, waiting = SuffixAutomaton(), key, []
                elif doc != first:  # what one document has goes in once all of it is matched
                    for sequence in waiting:
                        automaton.add(sequence)
                    waiting = []
                first = doc
                known = earlier_windows(automaton, words, window)
                if len(known) < len(words) - window + 1:
                    waiting.append(words)
                if known:
                    for column, value in zip(out, (span, more, [at + k for k in known])):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    def finer(piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Crowded shards are dealt anew: their spans are cut by the routes of longer pieces."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["shard", "first", "span", "more", "at", "words"]
            for b in batches:
                kinds = pa.int64(), b.schema.field(1).type, pa.int64(), pa.int64(), pa.int32(), pa.binary()
                out: list[list] = [[] for _ in names]
                for shard, first, span, more, at, words in zip(*(c.to_pylist() for c in b.columns)):
                    words = words.split()
                    r = routes(words, window, piece).view(np.int64)
                    for x, y in zip(*(k.tolist() for k in runs(r))):
                        for column, value in zip(out, (int(r[x]) ^ shard, first, span, more, at + x, b" ".join(words[x : y + window - 1]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

        return cut

    names = ["shard", "first", "span", "more", "at", "words"]
    several = saved(found.groupBy("route", "span", "more").agg(F.min("_doc").alias("first"), F.any_value("words").alias("words"), F.count("*").alias("n")), "distinct")
    rest = several.select(F.col("route").alias("shard"), "first", "span", "more", F.lit(0).alias("at"), "words")
    dealt, cuts = None, []
    for piece in (*(p for p in PIECES[1:] if p < window), window, None):
        sizes = rest.groupBy("shard").count().where("count > 1")
        if piece is None:  # whole windows: a shard is one window
            small, sizes = spread_join(rest, sizes.withColumn("weight", F.col("count")), ["shard"], "weight", rest.count()), None
        else:
            sizes = saved(sizes, "sizes")
            cuts.append(sizes)
            small = rest.join(sizes.where(F.col("count") <= CROWDED), "shard")
        dealt = small.select(names) if dealt is None else dealt.unionByName(small.select(names))
        crowded = None if sizes is None else sizes.where(F.col("count") > CROWDED)
        if crowded is None or crowded.isEmpty():
            break
        large = spread_join(rest, crowded.select("shard", F.col("count").alias("weight")), ["shard"], "weight", rest.count()).select(names)
        rest = saved(mapped(large, finer(piece), f"shard bigint, first {kind}, span bigint, more bigint, at int, words binary"), "cut")
        cuts.append(rest)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "first", "span", "more", "at")
    earlier = mapped(dealt, match, "span bigint, more bigint, earlier array<int>").groupBy("span", "more").agg(F.flatten(F.collect_list("earlier")).alias("earlier"))
    firsts = several.select("span", "more", "first", "n").join(earlier, ["span", "more"], "left")
    placed = spread_join(found.select("_doc", "_row", "span", "more", "begin", "end"), firsts, ["span", "more"], "n", found.count())
    whole = F.array(F.struct(F.col("begin"), F.col("end")))
    parts_of = F.transform("earlier", lambda k: F.struct((F.col("begin") + k).alias("begin"), (F.col("begin") + k + window).alias("end")))
    kept = placed.select("_doc", "_row", F.when(F.col("_doc") > F.col("first"), whole).otherwise(parts_of).alias("runs")).where(F.size("runs") > 0)
    out = saved(kept.groupBy("_doc", "_row").agg(F.flatten(F.collect_list("runs")).alias("_runs")), "covered")
    for table in (found, several, *cuts):
        dropped(table)
    return out


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _n_words, _n_removed, _kept (words joined by one space), _sha256 of _kept.

    Words are runs of anything but ASCII white space. A word goes if a window of `window` words that
    covers it stands in a document with a smaller id as well, ids of any type that has an order; windows are judged on the input.
    Null texts have no words and _kept is empty; documents with a null id keep all words and take none
    from others; rows with equal ids don't take from each other; shorter documents keep all; empty
    tables give no rows; other columns pass through, names that begin with an underscore are ours.
    """
    covered = covered_runs(docs, window, id_col, text_col)
    marked = docs.withColumns({"_doc": F.col(id_col), "_row": F.xxhash64(id_col, text_col)})
    joined = marked.join(covered, ["_doc", "_row"], "left").drop("_doc", "_row")
    text_at, runs_at = joined.columns.index(text_col), joined.columns.index("_runs")
    schema = joined.drop("_runs").schema.add("_n_words", "long").add("_n_removed", "long").add("_kept", "string").add("_sha256", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept, digests = [], [], [], []
            for text, found in zip(texts(b.column(text_at)), b.column(runs_at)):
                words = text.split()
                away = np.zeros(len(words) + 1, np.int64)
                if found.is_valid:
                    pairs = found.values
                    np.add.at(away, pairs.field(0).to_numpy(), 1)
                    np.add.at(away, pairs.field(1).to_numpy(), -1)
                away = np.cumsum(away[:-1]) > 0
                left = b" ".join([w for w, x in zip(words, away.tolist()) if not x])
                total.append(len(words))
                gone.append(int(away.sum()))
                kept.append(left.decode())
                digests.append(hashlib.sha256(left).hexdigest())
            columns = [c for k, c in enumerate(b.columns) if k != runs_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())], schema.names)

    return mapped(joined, cut, schema)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_sha256").alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), firsts AS (
  SELECT phrase, min(doc_id) AS f FROM win GROUP BY phrase HAVING count(DISTINCT doc_id) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN firsts USING (phrase) WHERE f < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
