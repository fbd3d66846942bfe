"""Near copies by the exact Jaccard likeness of shingle sets: candidates from SimHash fingerprints and, beyond their reach, from prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, mapped, parted, saved, scratch, spread_join, strips, texts
from .simhash import majority, near_links

SHINGLE, LEAST = 5, 0.8
#: One text in so many is read for what is common, shingles in so many of them are, and so many of these are sent out at most.
SAMPLE, COMMON, MOST_COMMON = 16, 4, 200_000
#: Postings of one shingle that are paired all with all at once; of larger groups only what is still apart is.
GROUP = 8
#: Orders in which large groups are dealt anew.
ORDERS = 4


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's different runs of n words, sorted; a shorter text is one run, a blank one has none."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.int64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[:-1]])[: max(1, len(words) - n + 1)].tolist()
    stops = (ends[n - 1 :] - 1 if len(words) >= n else ends[-1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[x:y]) for x, y in zip(begins, stops)], np.uint64).view(np.int64))


def enough(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def _pairs(sid: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, least: float, mode: str, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one shingle's postings.

    chain: neighbours by ascending size. all: every pair of different roots that sizes and places allow;
    of two sets that are alike enough, the first common shingle leaves enough on both sides behind it.
    dealt: in several orders that the key shuffles, each set and the next one, if their roots differ.
    """
    order = np.lexsort((sid, n))
    sid, n, at, root = sid[order], n[order], at[order], root[order]
    if mode == "chain":
        return sid[:-1], sid[1:]
    if mode == "dealt":
        orders = [np.argsort(sid * np.int64((key | 1) + 2 * r), kind="stable") for r in range(ORDERS)]
        a, b = np.concatenate([o[:-1] for o in orders]), np.concatenate([o[1:] for o in orders])
        fits = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-6)
        return sid[a[fits]], sid[b[fits]]
    a, b, last = [], [], np.searchsorted(n, n / least + 1e-6, side="right")
    for i in range(len(sid) - 1):
        j = np.arange(i + 1, last[i])
        need = least / (1 + least) * (n[i] + n[j]) - 1e-6
        j = j[(np.minimum(n[i] - at[i], n[j] - at[j]) >= need) & (root[j] != root[i])]
        a.append(np.repeat(sid[i], len(j)))
        b.append(sid[j])
    return np.concatenate(a), np.concatenate(b)


def _candidates(postings: DataFrame, least: float, large: str | None = None) -> DataFrame:
    """(a, b, key, n, at) of postings (key, sid, n, at): all pairs of small groups and chains of large ones, as (a, b) and nulls, and
    the postings of the large ones, with a as their sid and b null: they need no second shuffle of all postings.

    large: of large groups only, by the further column root, in this mode, and (a, b) alone.
    """

    names = ["key", "sid", "n", "at"] + ["root"] * bool(large)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * len(names)

        def groups(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            k = cols[0]
            cuts = np.nonzero(k[1:] != k[:-1])[0] + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
            a, b, held_back = [], [], 0
            if not large:
                crowd = np.nonzero(np.repeat(ends - begins > GROUP, ends - begins))[0]
                for i in range(0, len(crowd), 1 << 16):
                    key, sid, n, at = (c[crowd[i : i + (1 << 16)]] for c in cols)
                    row = pa.array(sid), pa.nulls(len(sid), pa.int64()), pa.array(key), pa.array(n, pa.int32()), pa.array(at, pa.int32())
                    yield pa.RecordBatch.from_arrays([*row], ["a", "b", "key", "n", "at"])
            wanted = np.nonzero(ends - begins > (GROUP if large else 1))[0]
            for i, j in zip(begins[wanted].tolist(), ends[wanted].tolist()):
                mode = large or ("chain" if j - i > GROUP else "all")
                x, y = _pairs(*[c[i:j] for c in cols[1:4]], cols[-1 if large else 1][i:j], least, mode, int(k[i]))
                a.append(x)
                b.append(y)
                held_back += len(x)
                if held_back > 1 << 18:
                    yield out(a, b)
                    a, b, held_back = [], [], 0
            if held_back:
                yield out(a, b)

        def out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            a_b = [pa.array(pairs[0].copy()), pa.array(pairs[1].copy())]
            if large:
                return pa.RecordBatch.from_arrays(a_b, ["a", "b"])
            none = [pa.nulls(pairs.shape[1], kind) for kind in (pa.int64(), pa.int32(), pa.int32())]
            return pa.RecordBatch.from_arrays([*a_b, *none], ["a", "b", "key", "n", "at"])

        for strip in strips(batches):
            cols = [np.concatenate([h, c]) for h, c in zip(held, strip)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            if cut:
                yield from groups([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if len(held[0]):
            yield from groups(held)

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.select(names).repartition(parts, "key").sortWithinPartitions("key")
    return mapped(dealt, compare, "a bigint, b bigint" + ", key bigint, n int, at int" * (not large)).distinct()


def sketch(h: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of about half as many buckets, a power of two; empty if one holds too many for a byte."""
    buckets = 1 << max(3, (len(h) // 2).bit_length())
    n = np.bincount(h & (buckets - 1), minlength=buckets)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b""


def most_shared(x: bytes, y: bytes) -> int | None:
    """At least as many hashes as two sets share: what their buckets have in common. None if a sketch says nothing."""
    if not x or not y:
        return None
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    m = min(len(a), len(b))  # the larger table is folded
    return int(np.minimum(a.reshape(-1, m).sum(0), b.reshape(-1, m).sum(0)).sum())


def _possible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) whose sketches allow the likeness: loses none that has it, and moves a small part of what a text takes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, m, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                most = most_shared(x, y)
                keep.append(most is None or most >= least * (n + m - most) - 1e-9)
            done = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([done.column(0), done.column(1)], ["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    few = parted(sketches.select("sid", "n", "sketch"), ids, ["sid"])[0].join(ids, "sid", "left_semi")
    side = lambda c: few.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return saved(mapped(both, check, "a bigint, b bigint"), "possible")


def _alike(pairs: DataFrame, sets: DataFrame, own: DataFrame, least: float, words: int) -> DataFrame:
    """Those of pairs (a, b) of sets whose texts' shingles are alike enough; only texts of pairs that sketches allow are moved."""
    pairs = _possible(pairs, sets, least)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = saved(sets.select("sid", "_tid").join(ids, "sid"), "wanted")
    found = saved(parted(own, wanted, ["_tid"])[0].join(wanted, "_tid").select("sid", "_text").dropDuplicates(["sid"]), "found")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = texts(batch.column(2)), texts(batch.column(3))
            keep, last, x = [], None, None
            for s, t in zip(left, right):
                if x is None or s != last:
                    last, x = s, shingles(s, words)
                keep.append(enough(x, shingles(t, words), least))
            done = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([done.column(0), done.column(1)], ["a", "b"])

    both = pairs.join(found.select(F.col("sid").alias("a"), F.col("_text").alias("x")), "a").join(found.select(F.col("sid").alias("b"), F.col("_text").alias("y")), "b")
    out = saved(mapped(both.select("a", "b", "x", "y"), check, "a bigint, b bigint"), "alike")
    for table in (pairs, found, wanted):
        dropped(table)
    return out


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, words: int = SHINGLE) -> DataFrame:
    """(id, _tid, _group) per row of docs: _tid is a hash of the text, _group one of what is near each other.

    Two texts are linked if the sets of their runs of `words` words (A-Z folded, ASCII white space
    between) have a Jaccard likeness of `least` or more; a group is what links connect.

    1. SimHash fingerprints over the same runs: what shares one, or is within four bits by its Golay
       keys, is compared.
    2. At a likeness of 0.8 most fingerprints differ in more bits than any keys can bridge. What is left
       is found without loss: in any one order of all runs, two such sets share one of the first
       |set| - ceil(least |set|) + 1 of each. Runs that a sample shows to be common come last in that
       order, which is a matter of cost and never of results.
    Every pair is decided by its exact likeness, if the sketches of the two sets allow it at all.

    Null and blank texts have the empty set and are one group; rows with equal texts stay apart as rows;
    an empty table gives no rows; other columns are ignored. A run's group of more than GROUP sets is
    chained first, then dealt in other orders, and only what these links leave
    apart is paired then, so that a crowd of near copies costs its number and not its square.
    """
    with scratch():
        return _near_copies(docs, id_col, text_col, least, words)


def _near_copies(docs: DataFrame, id_col: str, text_col: str, least: float, words: int) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(docs[id_col].alias(id_col), F.xxhash64(docs[text_col].cast("string")).alias("_tid"), docs[text_col].cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words))], ["key"])

    read = own.where(F.pmod("_tid", F.lit(SAMPLE)) == 0).select("_tid", "_text").dropDuplicates(["_tid"]).select("_text")
    often = mapped(read, sample, "key bigint").groupBy("key").count().where(F.col("count") >= COMMON)
    rows = sorted(tuple(r) for r in often.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect())
    common = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 2).T.copy())

    def ordered(h: np.ndarray) -> np.ndarray:
        key, count = common.value
        if not len(key):
            return h
        at = np.minimum(np.searchsorted(key, h), len(key) - 1)
        return h[np.lexsort((h, np.where(key[at] == h, count[at], 0)))]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, n, fps, sketches, keys = [], [], [], [], []
            for t in texts(b.column(2)):
                h = shingles(t, words)
                sid.append(xxhash.xxh64_intdigest(h.tobytes()))
                n.append(len(h))
                fps.append(majority(h.view(np.uint64)))
                sketches.append(sketch(h))
                keys.append(ordered(h)[: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1] if len(h) else h)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sid, fps)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed[0], pa.array(n, pa.int32()), signed[1], pa.array(sketches, pa.binary()), lists], [id_col, "_tid", "sid", "n", "fp", "sketch", "keys"])

    marked = saved(mapped(own, mark, f"`{id_col}` {kind}, _tid bigint, sid bigint, n int, fp bigint, sketch binary, keys array<bigint>"), "marked")
    # One row a set; the rest of what was marked is small.
    sets = saved(marked.select("sid", "_tid", "n", "fp", "sketch", "keys").dropDuplicates(["sid"]), "sets")
    named = saved(marked.select(id_col, "_tid", "sid"), "sids")
    dropped(marked)

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs, "pairs")  # its size is known then: few pairs are broadcast
        out = _alike(pairs, sets, own, least, words)
        dropped(pairs)
        return out

    prints = saved(sets.groupBy("fp").agg(F.min("sid").alias("sid"), F.count("*").alias("n")), "prints")
    a, b = (prints.select(F.col("fp").alias(c), F.col("sid").alias(f"sid_{c}")) for c in "ab")
    close = near_links(prints.select("fp")).join(a, "a").join(b, "b").select("sid_a", "sid_b")
    several = prints.where("n > 1").select("fp", F.col("sid").alias("sid_a"), "n")
    same = spread_join(sets.select("fp", F.col("sid").alias("sid_b")), several, ["fp"], "n", sets.count()).select("sid_a", "sid_b").where("sid_a <> sid_b")
    links = alike(close.unionByName(same).select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b")).distinct())

    postings = sets.select("sid", "n", F.posexplode("keys").alias("at", "key"))
    first = saved(_candidates(postings, least), "first")
    links = links.unionByName(alike(first.where("b is not null").select("a", "b").join(links, ["a", "b"], "left_anti")))
    crowd = first.where("b is null").select("key", F.col("a").alias("sid"), "n", "at")
    for mode in ("dealt", "all"):
        roots = saved(components(links), "roots")
        apart = crowd.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        links = links.unionByName(alike(_candidates(apart, least, mode)))
    roots = saved(components(links), "roots")
    return saved(named.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(id_col, "_tid", F.coalesce("root", "sid").alias("_group")), "named", kept=True)
