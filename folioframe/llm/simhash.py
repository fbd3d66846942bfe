"""SimHash near-duplicates by Golay-code fuzzy keys (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, mapped, saved, strips, texts

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Shingles hashed at once: bounds the memory that a very long text takes.
PART = 1 << 18
#: Generator of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Fingerprints of one key that are compared all with all; larger groups are split once more.
GROUP = 1024


def majority(h: np.ndarray) -> int:
    """Bit k is set if it is set in over half of some 64-bit numbers."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), PART):
        ones += np.unpackbits(h[i : i + PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes) -> int:
    """Bit k is set if it is set in over half the XXH64 values of the text's shingles."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - SHINGLE + 1)
    stops = ends[SHINGLE - 1 :] - 1 if len(words) >= SHINGLE else ends[-1:] - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, PART):
        a, b = begins[i : min(i + PART, n)].tolist(), stops[i : i + PART].tolist()
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(a, b)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row of docs; fp is the fingerprint's bits as a signed long. Null and blank texts have 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x) for x in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], [id_col, "fp"])

    return mapped(frame, run, f"`{id_col}` {kind}, fp bigint")


@lru_cache(maxsize=1)
def cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes by the low 12 bits, by the high 11 bits, error patterns by syndrome: six, -1 where there are fewer)."""
    one = []
    for k in range(23):
        r = 1 << k
        for i in range(22, 10, -1):
            if r >> i & 1:
                r ^= GENERATOR << (i - 11)
        one.append(r)

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int64)
        for k, s in enumerate(bits):
            out ^= np.where(np.arange(len(out)) >> k & 1, s, 0)
        return out

    patterns = np.full((1 << 11, 6), -1, np.int64)
    filled = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = 0
            for k in places:
                syndrome ^= one[k]
            patterns[syndrome, filled[syndrome]] = sum(1 << k for k in places)
            filled[syndrome] += 1
    return table(one[:12]), table(one[12:]), patterns


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Six keys of each 23-bit word, -1 where there are fewer: the low 12 bits, which tell codewords apart, of codewords nearby.

    A word within two bits of a codeword has that one. Any other is three bits from one codeword and
    four bits from five more; these six are its keys. Two words that differ in two bits or fewer share
    a key: with a codeword within two bits of either, the other is within four; and if both are three
    bits from theirs, the seven-bit codewords that hold a word's three-bit error split the other places
    into five fours, so that one of the six lies within four bits of both.
    """
    low, high, patterns = cosets()
    found = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(found >= 0, (words[:, None] ^ found) & 0xFFF, -1)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) so that fingerprints that differ in four bits or fewer share a key.

    Segments: a and b of 23 bits, c of 18. By where four errors can lie:
    - none in c: a or b has two at most: c whole, and a Golay key of a, or of b;
    - none in a, or in b: the other has three at most; if two at most, that one's Golay key, else c has
      one: c's Golay key; with the faultless segment whole;
    - some in each: a and b have two at most, and c two at most, so one of its three parts of six bits
      has none: Golay keys of a and of b, with that part.
    """
    a, b, c = (fps & 0x7FFFFF).astype(np.int64), (fps >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64), (fps >> np.uint64(46)).astype(np.int64)
    ka, kb, kc = golay_keys(a), golay_keys(b), golay_keys(c)
    row = np.arange(len(fps))
    rows, out = [], []

    def add(kind: int, whole: np.ndarray, some: np.ndarray) -> None:
        """whole: what must agree; some: keys by row and place, -1 where a row has none."""
        r, k = np.nonzero(some >= 0)
        rows.append(row[r])
        out.append(kind << 59 | whole[r] << 24 | some[r, k])

    add(0, c, ka)
    add(1, c, kb)
    add(2, a, kb)
    add(3, a, kc)
    add(4, b, ka)
    add(5, b, kc)
    both = np.where((ka[:, :, None] >= 0) & (kb[:, None, :] >= 0), ka[:, :, None] << 12 | kb[:, None, :], -1).reshape(len(fps), 36)
    for k in range(3):
        add(6 + k, c >> 6 * k & 63, both)
    return np.concatenate(rows), np.concatenate(out)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of n places over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(fps: np.ndarray, most: int = MOST_BITS, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct fingerprints that connect all those of the group that links of `most` bits connect.

    A group beyond GROUP is split by each fifth of the bits: of five parts one has no error. What is
    still larger, all alike in a part, is compared in strips. Of each comparison only one pair a
    fingerprint stays, not all of a cluster.
    """
    n = len(fps)
    if n > GROUP and split:
        pairs = []
        for k in range(0, 64, 13):
            part = fps >> np.uint64(k) & np.uint64((1 << 13) - 1)
            order = np.argsort(part, kind="stable")
            for g in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
                if len(g) > 1:
                    pairs.append(linked(fps[g], most, False))
        if not pairs:
            return fps[:0], fps[:0]
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    root = np.arange(n)
    for i in range(0, n, GROUP):
        near = np.bitwise_count(fps[i : i + GROUP, None] ^ fps[None, i:]) <= most
        x, y = np.nonzero(near)
        keep = x < y
        if keep.any():
            roots = _roots(n, np.concatenate([x[keep] + i, np.arange(n)]), np.concatenate([y[keep] + i, root]))
            root = roots
    away = root != np.arange(n)
    return fps[away], fps[root[away]]


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that leave no pair within four bits unconnected.

    Each fingerprint goes out under its fuzzy keys; a group is what shares one, read key by key from
    sorted partitions, eight bytes a fingerprint; keys that only one fingerprint has cost nothing more.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 4096):
                rows, keys = fuzzy_keys(fp[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[i : i + 4096][rows].view(np.int64))], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def groups(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            same = k[1:] == k[:-1]
            if not same.any():
                return
            cuts = np.nonzero(~same)[0] + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
            size = ends - begins
            a, b = [], []
            for m in range(2, 9):  # small groups of one size at once
                at = begins[size == m]
                for i in range(m):
                    for j in range(i + 1, m):
                        x, y = f[at + i], f[at + j]
                        near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= MOST_BITS
                        a.append(x[near])
                        b.append(y[near])
            for i, j in zip(begins[size > 8], ends[size > 8]):
                x, y = linked(f[i:j].view(np.uint64))
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], ["a", "b"])

        for keys, fps in strips(batches):
            k, f = np.concatenate([held_k, keys]), np.concatenate([held_f, fps])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            yield from groups(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
        yield from groups(held_k, held_f)

    keyed = mapped(fps.select("fp"), expand, "key bigint, fp bigint")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key")
    return mapped(dealt, compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per row of docs.

    component_id is the smallest id reachable over links of four differing bits or fewer, its own
    included; null ids are not candidates for it (null only if no member has an id). Null, empty and
    blank texts have fingerprint zero and link like any other; rows with equal ids or texts stay apart
    as rows and share a component; an empty table gives no rows; other columns are ignored.
    """
    marked = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    lowest = marked.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = components(near_links(lowest))
    families = saved(
        lowest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "families"
    )
    least = families.groupBy("root").agg(F.min("low").alias("component_id"))
    named = families.join(least, "root").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(named, "fp").select(id_col, shown, "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
