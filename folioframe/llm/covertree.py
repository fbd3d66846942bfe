"""Embedding near-duplicates by dual traversal of cover trees (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, dropped, mapped, saved
from .simhash import _roots

COSINE = 0.95
#: Numbers in the vectors of one part of a cell: a task compares two parts.
PART = 1 << 19
#: Top-level cells at most, and vectors of the sample they are chosen from; both bound what is broadcast.
CELLS, SAMPLE = 512, 8192
#: A node of so few points has them as its children.
FEW = 32
#: Angle and cosine that rounding may cost, and the radius below which points are one place.
SLACK, ROUND, PLACE = 1e-5, 1e-4, 1e-6


def angles(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ center, -1.0, 1.0))


def net(x: np.ndarray, points: np.ndarray, center: int, radius: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner by point): centres, `center` first, farther than `radius` apart, within which every point has its owner."""
    close = math.cos(radius)
    centers = [center]
    owner = np.where((x[points] @ x[center] >= close) | (points == center), 0, -1)
    rest = np.nonzero(owner < 0)[0]
    while len(rest):
        block = points[rest[:step]]
        near = x[block] @ x[block].T >= close
        left, new = np.ones(len(block), bool), []
        while left.any():
            k = int(left.argmax())
            new.append(block[k])
            left &= ~near[k]
            left[k] = False
        likeness = x[points[rest]] @ x[new].T
        best = likeness.argmax(1)
        held = likeness[np.arange(len(rest)), best] >= close
        held[: len(block)] = True
        own = {int(c): i for i, c in enumerate(new)}
        for i, c in enumerate(points[rest[: len(block)]].tolist()):  # a centre owns itself, whatever rounding says
            best[i] = own.get(c, best[i])
        owner[rest[held]] = best[held] + len(centers)
        centers += new
        rest = rest[~held]
    return np.array(centers), owner


class Node:
    """Points within `radius` of one of them; children, made when they are asked for, cover them with half that radius.

    The centre is a child's centre again, so levels are nested. Children of one point are kept as
    points, the others as nodes.
    """

    __slots__ = ("_children", "center", "points", "radius", "x")

    def __init__(self, x: np.ndarray, points: np.ndarray, center: int | None = None, level: tuple[np.ndarray, np.ndarray] | None = None):
        self.x, self.points = x, points
        self.center = int(points[0]) if center is None else center
        self.radius = float(angles(x[points], x[self.center]).max())
        self._children = None if level is None else self._parted(*level)

    def _parted(self, centers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[Node]]:
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(centers) + 1))
        size = np.diff(bounds)
        wide = [Node(self.x, self.points[order[bounds[k] : bounds[k + 1]]], int(centers[k])) for k in np.nonzero(size > 1)[0]]
        return self.points[order[bounds[:-1][size == 1]]], wide

    def children(self) -> tuple[np.ndarray, list[Node]]:
        """(single points, nodes)"""
        if self._children is None:
            if len(self.points) <= FEW or self.radius < PLACE:
                self._children = self.points, []
            else:
                self._children = self._parted(*net(self.x, self.points, self.center, self.radius / 2))
        return self._children


class Links:
    """Linked points of one matrix of unit vectors, by dual traversal: how many each has, and one connected point of each.

    A pair of nodes drops out where their centres are farther apart than both radii and the reach, and
    links as a whole where even the farthest points are within reach; else their children pair up.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray, least: float):
        self.x, self.weight, self.least, self.reach = x, weight, least, math.acos(least)
        self.single = x.astype(np.float32)
        self.n = np.zeros(len(x), np.int64)
        self.root = np.arange(len(x))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        #: Pairs of points whose likeness was taken.
        self.compared = 0

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        self.edges.append((p, q))
        self.waiting += len(p)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> np.ndarray:
        own = np.arange(len(self.x))
        self.root = _roots(len(own), np.concatenate([*(e[0] for e in self.edges), own]), np.concatenate([*(e[1] for e in self.edges), self.root]))
        self.edges, self.waiting = [], 0
        return self.root

    def whole(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """All of a link with each other, or with all of b."""
        if b is None:
            self.n[a] += self.weight[a].sum() - self.weight[a]
        else:
            self.n[a] += self.weight[b].sum()
            self.n[b] += self.weight[a].sum()
            a = np.concatenate([a, b])
        self.join(a[1:], np.repeat(a[:1], len(a) - 1))

    def points(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """Points with points: single precision finds candidates, double precision decides."""
        other = a if b is None else b
        self.compared += len(a) * (len(a) - 1) // 2 if b is None else len(a) * len(b)
        for i in range(0, len(a), 1024):
            # among themselves: only with later ones
            start = i if b is None else 0
            p, q = np.nonzero(self.single[a[i : i + 1024]] @ self.single[other[start:]].T >= self.least - ROUND)
            if b is None:
                p, q = p[p < q], q[p < q]
            p, q = a[p + i], other[q + start]
            for j in range(0, len(p), 1 << 18):
                u, v = p[j : j + (1 << 18)], q[j : j + (1 << 18)]
                ok = np.einsum("ij,ij->i", self.x[u], self.x[v]) >= self.least
                u, v = u[ok], v[ok]
                np.add.at(self.n, u, self.weight[v])
                np.add.at(self.n, v, self.weight[u])
                self.join(u, v)

    def node_points(self, a: Node, b: np.ndarray) -> None:
        """A node with points: those too far from its ball drop out, those within reach of all of it link with all."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            away = angles(self.x[b], self.x[a.center])
            near = away + a.radius <= self.reach - SLACK
            if near.any():
                self.whole(a.points, b[near])
            b = b[~near & (away <= a.radius + self.reach + SLACK)]
            if len(b):
                few, wide = a.children()
                self.points(few, b)
                stack += [(c, b) for c in wide]

    def nodes(self, a: Node, b: Node) -> None:
        """All pairs between two nodes, or within one."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if a is b:
                if 2 * a.radius <= self.reach - SLACK:
                    self.whole(a.points)
                    continue
                few, wide = a.children()
                self.points(few)
                for k, c in enumerate(wide):
                    self.node_points(c, few)
                    stack += [(c, d) for d in wide[k:]]
                continue
            away = math.acos(max(-1.0, min(1.0, float(self.x[a.center] @ self.x[b.center]))))
            if away + a.radius + b.radius <= self.reach - SLACK:
                self.whole(a.points, b.points)
            elif away <= a.radius + b.radius + self.reach + SLACK:
                (few, wide), (others, wider) = a.children(), b.children()
                self.points(few, others)
                for c in wide:
                    self.node_points(c, others)
                for d in wider:
                    self.node_points(d, few)
                if wide and wider:  # in one product which of the children can link
                    c, d = np.array([c.center for c in wide]), np.array([d.center for d in wider])
                    bound = np.add.outer([c.radius for c in wide], [d.radius for d in wider]) + self.reach + SLACK
                    stack += [(wide[i], wider[j]) for i, j in zip(*(k.tolist() for k in np.nonzero(angles(self.x[c], self.x[d].T) <= bound)))]


def units(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore", under="ignore"):
        x = x / np.abs(x).max(1, keepdims=True)  # no square of a huge or tiny number
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(distinct: DataFrame, n: int, part: int) -> np.ndarray:
    """Top-level centres, farthest first, from a bounded sample: the vectors of least hash."""
    sample = distinct.orderBy("k1", "k2").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    x = units(sample)
    chosen = [0]
    near = angles(x, x[0])
    while len(chosen) < min(CELLS, max(1, math.ceil(n / part)), len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, angles(x, x[chosen[-1]]))
    return x[chosen]


def links(distinct: DataFrame, width: int, least: float) -> DataFrame:
    """(k1, k2, n, root): for vectors (k1, k2, v, copies) of one length, linked copies and one connected vector's k1, a row a task.

    1. Each vector goes to the nearest of the top-level centres; a cell's radius is its farthest vector.
       Cells are dealt in parts of bounded size, whatever one cell holds.
    2. Each part becomes a node of the tree with its first level, written as one row.
    3. Parts meet in pairs; those of cells too far apart for a link, and parts too far from the other
       cell's ball, do not. A task goes down both trees. It counts links and keeps, of the linked
       vectors, one connected representative each, not the pairs.
    """
    reach = math.acos(least) + SLACK
    spark = distinct.sparkSession
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], "k1 bigint, k2 bigint, n bigint, root bigint")
    part = max(256, PART // width)
    centers = cells(distinct, n, part)
    sent = spark.sparkContext.broadcast(centers)
    kind = distinct.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = np.arccos(np.clip(units(b.column(2)) @ sent.value.T, -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(away.argmin(1).astype(np.int32)), pa.array(away.min(1))], ["k1", "k2", "v", "copies", "cell", "away"])

    placed = saved(mapped(distinct.select("k1", "k2", "v", "copies"), assign, f"k1 bigint, k2 bigint, v {kind}, copies bigint, cell int, away double"), "cells")
    sizes = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}
    parts = np.array([math.ceil(sizes.get(c, (0, 0))[0] / part) for c in range(len(centers))])
    radius = np.array([sizes.get(c, (0, 0.0))[1] for c in range(len(centers))])
    apart = np.arccos(np.clip(centers @ centers.T, -1, 1)) - radius[:, None] - radius[None] > reach
    apart |= (parts == 0)[:, None] | (parts == 0)[None]
    plan = spark.sparkContext.broadcast((centers, parts, radius, apart))
    names = ["cell", "part", "k1", "k2", "copies", "v", "centers", "owner"]
    numbers = pa.list_(pa.int64())

    def plant(group: pa.Table) -> pa.Table:
        x = units(group.column("v").combine_chunks())
        node = Node(x, np.arange(len(x)))
        level = net(x, node.points, node.center, node.radius / 2) if node.radius >= PLACE else (np.zeros(1, np.int64), np.zeros(len(x), np.int64))
        row = [pa.array([group.column(c)[0].as_py()], pa.int32()) for c in ("cell", "part")] + [pa.array([group.column(c).to_numpy()], numbers) for c in ("k1", "k2", "copies")]
        row += [pa.array([group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)], group.schema.field("v").type)] + [pa.array([k], numbers) for k in level]
        return pa.Table.from_arrays(row, names)

    schema = f"cell int, part int, k1 array<bigint>, k2 array<bigint>, copies array<bigint>, v {kind}, centers array<bigint>, owner array<bigint>"
    count = F.element_at(F.array(*[F.lit(int(k)) for k in np.maximum(parts, 1)]), F.col("cell") + 1)
    dealt = placed.withColumn("part", F.pmod("k2", count).cast("int"))
    several = int(spark.conf.get("spark.sql.shuffle.partitions"))
    planted = saved(dealt.select("cell", "part", "k1", "k2", "copies", "v").repartition(several, "cell", "part").groupBy("cell", "part").applyInArrow(plant, schema), "trees")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tree under the key of every pair it is in."""
        centers, parts, radius, apart = plan.value
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                own, number = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                x = units(pa.FixedSizeListArray.from_arrays(row.column(5).flatten(), width))
                away, reached = angles(centers, x[0]), float(angles(x, x[0]).max()) + reach
                for c in np.nonzero(~apart[own] & (away <= reached + radius))[0].tolist():
                    for p in range(parts[c]):
                        first, second = sorted([(own, number), (c, p)])
                        key = first[0] << 54 | second[0] << 44 | first[1] << 22 | second[1]
                        yield pa.RecordBatch.from_arrays([*row.columns, pa.array([key])], [*names, "key"])

    def compare(group: pa.Table) -> pa.Table:
        k1, k2, copies = (np.concatenate([r.values.to_numpy() for r in group.column(c)]) for c in ("k1", "k2", "copies"))
        x = units(pa.FixedSizeListArray.from_arrays(pa.concat_arrays([r.values for r in group.column("v")]), width))
        found, nodes, start = Links(x, copies, least), [], 0
        for centers, owner in zip(group.column("centers"), group.column("owner")):
            points = np.arange(start, start + len(owner))
            nodes.append(Node(x, points, start, (centers.values.to_numpy() + start, owner.values.to_numpy())))
            start += len(points)
        key = group.column("key")[0].as_py()
        alone = (key >> 54) == (key >> 44 & 0x3FF) and (key >> 22 & 0x3FFFFF) == (key & 0x3FFFFF)
        if alone or len(nodes) == 2:  # of two parts one may be out of the other cell's reach
            found.nodes(nodes[0], nodes[-1])
        root = found.settle()
        at = np.nonzero(found.n)[0]
        return pa.table([k1[at], k2[at], found.n[at], k1[root[at]]], ["k1", "k2", "n", "root"])

    paired = mapped(planted, pair, schema + ", key bigint").repartition(several, "key")
    out = saved(paired.groupBy("key").applyInArrow(compare, "k1 bigint, k2 bigint, n bigint, root bigint"), "links")
    dropped(placed)
    dropped(planted)
    return out


def near_vectors(vectors: DataFrame, *, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) per row of vectors: links at cosine `least` or more, in double precision.

    Null, empty and zero vectors, vectors with null or non-finite components and rows with a null id
    link with nothing: no links, their own component. Vectors of different lengths don't link. Equal
    vectors are compared once and count as often as they stand; rows with equal ids stay apart as rows.
    An empty table gives no rows; other columns are ignored.
    """
    v = F.col("v")
    element = vectors.schema[vector_col].dataType.elementType
    kind = "array<float>" if isinstance(element, FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))  # a null, no number or infinite: not fine
    fine = F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    keyed = rows.withColumn("k1", F.when(fine, F.xxhash64("v"))).withColumn("k2", F.when(fine, F.xxhash64(F.lit(1), "v")))
    distinct = saved(
        keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first(F.size("v")).alias("width")), "vectors"
    )
    widths = [r["width"] for r in distinct.select("width").distinct().collect()]
    found = None
    for w in widths:
        new = links(distinct.where(F.col("width") == w), w, least)
        found = new if found is None else found.unionByName(new)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "k1 bigint, k2 bigint, n bigint, root bigint")
    counts = found.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("k1").alias("a"), F.col("root").alias("b")))
    named = distinct.select("k1", "k2", "low", "copies").join(roots.withColumnRenamed("node", "k1"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    named = saved(named, "named")
    dropped(distinct)
    least_id = named.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = named.join(least_id, "root").join(counts, ["k1", "k2"], "left").select("k1", "k2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.select("id", "k1", "k2").join(facts, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), r AS (
  SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT node, b FROM r JOIN l ON reach = a
)
SELECT node AS vec_id, (SELECT count(*) FROM l WHERE a = node)::BIGINT AS n_links, min(reach) AS component_id, min(reach) = node AS kept FROM r GROUP BY node
"""
