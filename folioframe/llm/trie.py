"""The prefix trie of conversations, with totals of all subtrees by time-forward processing (operator 13)."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, mapped, saved, spread_join

#: A rebuilt conversation takes up to MOST - 1 turns from the first of its family of FAMILY.
FAMILY, MOST = 5, 9
#: A subtree of more than a SHARDS-th of all conversations is cut into those below it.
SHARDS = 4096
#: Messages that a priority queue keeps in memory; more are sorted and spilled.
HELD = 1 << 16
#: Bytes of joined ids in a block.
BLOCK = 1 << 16
ROOT = b"\0" * 16
STEPS = "conv_id long, depth int, path binary, parent binary, bytes long, ends boolean"
TOTALS = "shard binary, path binary, parent binary, depth int, conv_id long, n_convs long, n_ends long, n_children long, n_leaves long, saved_tokens long"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes): the texts stay where they are read, behind a digest of 32 bytes.

    The role's length goes first, so that no two pairs of role and text are joined to one string.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, conv_id, digest, bytes), families together, the first conversation of each first, turns in order, to rows of STEPS.

    The path of a node is a hash of its parent's and of its turn. Held are the first turns of a family and one
    path, whatever the length of a conversation; the row of depth 0 stands for the root.
    """
    family, conv, first, skip, seen, depth, path, last = None, None, [], 0, 0, 0, ROOT, None

    def step(digest: bytes, size: int) -> Iterator[tuple]:
        nonlocal depth, path, last
        if last is not None:
            yield (*last, False)
        depth, parent, path = depth + 1, path, hashlib.sha256(path + digest).digest()[:16]
        last = (conv, depth, path, parent, size)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "depth", "path", "parent", "bytes", "ends"])

    for b in batches:
        out: list[tuple] = []
        for f, c, digest, size in zip(*(x.to_pylist() for x in b.columns)):
            if f != family:
                family, first = f, []
            if c != conv:
                if last is not None:
                    out.append((*last, True))
                conv, depth, path, seen, last = c, 0, ROOT, 0, (c, 0, ROOT, None, 0)
                skip = zlib.crc32(str(c).encode()) % MOST if c != f else 0
                for d, s in first[:skip]:
                    out.extend(step(d, s))
            if c == f and len(first) < MOST - 1:
                first.append((digest, size))
            seen += 1
            if seen > skip:
                out.extend(step(digest, size))
        yield batch(out)
    if last is not None:
        yield batch([(*last, True)])


def steps(own: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: (conv_id, depth, path, parent, bytes, ends)."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    placed = own.withColumn("family", family)
    # Rows of one turn number are ordered by their digests; equal ones are the same turn twice.
    ordered = placed.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return mapped(ordered.select("family", "conv_id", "digest", "bytes"), chained, STEPS)


class Queue:
    """A priority queue of which at most `held` messages are in memory: beyond that, sorted runs go to files without a name, which end with the task."""

    def __init__(self, held: int = HELD) -> None:
        self.held, self.heap, self.runs = held, [], []

    def push(self, message: tuple) -> None:
        if len(self.heap) >= self.held:
            f = tempfile.TemporaryFile()  # noqa: SIM115  closed with its run
            for m in sorted(self.heap):
                pickle.dump(m, f)
            f.seek(0)
            self.heap = []
            self._next(f)
        heapq.heappush(self.heap, message)

    def _next(self, f) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(f), id(f), f))
        except EOFError:
            f.close()

    def least(self) -> tuple | None:
        tops = ([self.heap[0]] if self.heap else []) + ([self.runs[0][0]] if self.runs else [])
        return min(tops, default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            message, _, f = heapq.heappop(self.runs)
            self._next(f)
            return message
        return heapq.heappop(self.heap)


def forwarded(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """(shard, path, parent, depth, conv_id, n_convs, n_ends, n_children, n_leaves, saved_tokens), by shard and from the deepest level up, paths in order, to rows of TOTALS.

    Counts that come in are a node's own: children and leaves outside of the shard, and its tokens. A node's
    total is what it has and what its children sent; it goes to its parent, whose turn is later, by level and path.
    """
    shard, queue = None, Queue(held)
    for b in batches:
        out = []
        for s, path, parent, depth, conv, convs, ends, children, leaves, saved_ in zip(*(x.to_pylist() for x in b.columns)):
            if s != shard:
                shard, queue = s, Queue(held)
            while (m := queue.least()) is not None and m[:2] <= (-depth, path):
                at, to, more_leaves, more_saved = queue.pop()
                if (at, to) == (-depth, path):  # else it goes to a parent outside of the shard
                    children, leaves, saved_ = children + 1, leaves + more_leaves, saved_ + more_saved
            leaves = leaves if children else 1
            if parent is not None:
                queue.push((1 - depth, parent, leaves, saved_))
            out.append((s, path, parent, depth, conv, convs, ends, children, leaves, saved_))
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=b.schema.names)


def totals(nodes: DataFrame) -> DataFrame:
    """Time-forward processing of all shards: sorted outside of Python, one pass each."""
    columns = [c.split()[0] for c in TOTALS.split(", ")]
    ordered = nodes.select(columns).repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "path")
    return mapped(ordered, forwarded, TOTALS)


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, conv_id) in order to (path, first, ids): runs of one path as texts of about BLOCK bytes."""
    now, first, ids, size, out = None, 0, [], 0, []

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["path", "first", "ids"])
        out.clear()
        return done

    for b in batches:
        for path, conv in zip(*(x.to_pylist() for x in b.columns)):
            if path != now or size > BLOCK:
                if ids:
                    out.append((now, first, ",".join(ids)))
                now, first, ids, size = path, conv, [], 0
            ids.append(text := str(conv))
            size += len(text) + 1
        yield batch()
    if ids:
        out.append((now, first, ",".join(ids)))
        yield batch()


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, first, ids) in order to (path, ends_sha256): the digest goes along the blocks of a path."""
    now, sha = None, None
    for b in batches:
        out = []
        for path, _, ids in zip(*(x.to_pylist() for x in b.columns)):
            if path != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = path, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.string()))], names=["_end", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], names=["_end", "ends_sha256"])


def ends(found: DataFrame) -> DataFrame:
    """(path, conv_id) of where conversations end to (_end, ends_sha256).

    Ids of one path are dealt by ranges of ids as well, so that a path where a third of all end is sorted and
    joined in many tasks; what meets by path are blocks of some thousand ids.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = mapped(found.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id"), joined_ids, "path binary, first long, ids string")
    return mapped(blocks.repartition("path").sortWithinPartitions("path", "first"), hashed_ids, "_end binary, ends_sha256 string")


def trie(conversations: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, turns go by number (null first; rows of one number by a digest, both
    kept), rows without conv_id are no conversation's; no conversations, no nodes. Other columns are not read.

    A shard is a subtree of at most a `shards`-th of all conversations whose parent has more. Nodes above have
    that many members each, so they are at most `shards` times the mean length of a conversation: they are
    the last shard, to which the others pass the totals of their roots, summed by parent.
    """
    path = saved(steps(turns(conversations)), "steps")
    every = path.groupBy("path", "parent", "depth").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"), F.sum(F.col("ends").cast("long")).alias("n_ends"))
    every = saved(every, "nodes")
    most = max(1, path.where("depth = 0").count() // shards)
    top = saved(every.where(F.col("n_convs") > most).select("path"), "top")
    # A conversation leaves the top once; all below that step is in the shard of the node it leads to.
    roots = path.join(top, "path", "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "path"))["path"].alias("shard"))
    own = every.select("path", "parent", "depth", "conv_id", "n_convs", "n_ends", F.lit(0).cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    low = saved(totals(own.where(F.col("n_convs") <= most).join(roots, "conv_id")), "low")
    sent = low.where("shard = path").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    high = own.where(F.col("n_convs") > most).join(sent, "path", "left").withColumns({
        "n_children": F.coalesce("c", F.lit(0)), "n_leaves": F.coalesce("l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("s", F.lit(0)), "shard": F.lit(ROOT),
    })
    whole = saved(low.unionByName(totals(high)), "totals")
    # A parent may have a third of all nodes as its children.
    parents = whole.where("n_children > 0").select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    named = spread_join(whole.where("parent is not null").select("path", "parent"), parents, ["parent"], "n_children", whole.count()).select(F.col("path").alias("_path"), "parent_conv_id")
    named = whole.join(named, F.col("path") == F.col("_path"), "left")
    last = ends(path.where("ends").select("path", "conv_id"))
    out = named.join(last, F.col("path") == F.col("_end"), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    out = saved(out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")), "trie")
    for df in (path, every, top, low, whole):
        dropped(df)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL)
), c AS (  -- the checksum: each byte, then eight times a bit
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h
), s AS (
  SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER w AS path, strlen(text) AS bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, [], 0 FROM c
), m AS (
  SELECT s.*, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM s
), n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, string_agg(CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ended FROM m GROUP BY path, depth
), k AS (
  SELECT p.path, count(*) AS n_children FROM n p JOIN n q ON q.depth = p.depth + 1 AND q.path[:p.depth] = p.path GROUP BY p.path
), u AS (  -- every node under each of its prefixes
  SELECT p.path, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (k.path IS NULL) AS n_leaves
  FROM n LEFT JOIN k USING (path) JOIN m p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens, sha256(coalesce(n.ended, '')) AS ends_sha256
FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND n.path[:n.depth - 1] = p.path LEFT JOIN k ON k.path = n.path JOIN u ON u.path = n.path
"""
