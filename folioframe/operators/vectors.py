"""A stored inverted file of vectors: cells around centres, exact nearest neighbours, filters inside the cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells of an index at most, vectors that the centres are chosen from, and queries that go out at once.
CELLS, SAMPLE, BLOCK = 1024, 16_384, 4096
#: What rounding may add to a distance of unit vectors.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Vectors of one length by cell: the table's folder, and one centre a cell."""

    spark: SparkSession
    path: str
    centres: np.ndarray

    def rows(self) -> DataFrame:
        """(cell, reach, id, vector, ...): reach is a vector's distance from its centre; the folder of a cell is its number."""
        return self.spark.read.parquet(self.path)


def usable(vector: str | Column) -> Column:
    """Neither null nor zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres_of(vectors: DataFrame, *, id_col: str, vector_col: str, cells: int, sample: int = SAMPLE, rounds: int = 5) -> np.ndarray:
    """At most `cells` directions: a few rounds of spherical means over a bounded sample, by hash of the id; alike on every run."""
    few = vectors.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).toArrow().column(0).combine_chunks()
    x = _matrix(few)
    c = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def build(vectors: DataFrame, path: str, *, id_col: str, vector_col: str, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Writes vectors (an id, a vector, and columns to filter by) to `path`, one folder a cell.

    All usable vectors are indexed, of the length of the first one by id; a vector belongs to the centre it is most like. Only
    the centres (CELLS at most) are at the driver and sent to the tasks. Without vectors there is no index.
    """
    spark = vectors.sparkSession
    fine = vectors.where(usable(vector_col)).withColumnsRenamed({id_col: "id", vector_col: "vector"})
    head = fine.agg(F.min_by(F.size("vector"), "id").alias("d"), F.count("*").alias("n")).first()
    if not head["n"]:
        raise ValueError("there is nothing to index")
    fine = fine.where(F.size("vector") == head["d"])
    centres = centres_of(fine, id_col="id", vector_col="vector", cells=cells or int(min(CELLS, max(1, head["n"] ** 0.5))), sample=sample)
    sent = spark.sparkContext.broadcast(centres)
    names = fine.columns
    at = names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                likeness = _matrix(b.column(at)) @ sent.value.T
                own = likeness.argmax(axis=1)
                reach = np.sqrt(np.maximum(0, 2 - 2 * likeness[np.arange(len(own)), own]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(reach)], [*names, "cell", "reach"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fine.schema)
    # A cell may hold a third of all vectors: rows of a cell are dealt to tasks by their reach as well.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = fine.mapInArrow(run, f"{kinds}, cell int, reach double").repartitionByRange(parts, "cell", "reach").sortWithinPartitions("cell", "reach")
    placed.write.partitionBy("cell").parquet(path)
    return Index(spark, path, centres)


def reached(index: Index, q: np.ndarray, counts: dict[int, tuple[int, float, float]], bound: np.ndarray) -> np.ndarray:
    """Which cells (columns) may hold a vector within `bound` of each query, by the triangle of query, centre and vector."""
    to = np.sqrt(np.maximum(0, 2 - 2 * q @ index.centres.T))
    out = np.zeros(to.shape, bool)
    for cell, (_, near, far) in counts.items():
        out[:, cell] = np.maximum(to[:, cell] - far, near - to[:, cell]) <= bound + SLACK
    return out


def first_cells(index: Index, q: np.ndarray, counts: dict[int, tuple[int, float, float]], k: int) -> np.ndarray:
    """The nearest cells of each query that hold k vectors together."""
    out = np.zeros((len(q), len(index.centres)), bool)
    own = np.array(sorted(counts))
    if len(own):
        sizes = np.array([counts[c][0] for c in own])
        order = np.argsort(-(q @ index.centres[own].T), axis=1, kind="stable")
        upto = np.cumsum(sizes[order], axis=1) - sizes[order]
        rows, places = np.nonzero(upto < k)
        out[rows, own[order[rows, places]]] = True
    return out


def search(index: Index, queries: DataFrame, k: int, *, id_col: str, vector_col: str, where: Column | None = None, itself: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): the k rows of the index nearest to each query by cosine distance, among those that `where` lets through; ties by id.

    Exact. `where` reads columns of the index and goes down to its scan. First, counts and reaches of the
    filtered cells (no vectors are read for that); then the nearest cells with k rows give each query a bound;
    then only cells that may hold something nearer than it are read. A row with the query's id is left out unless `itself`.
    Distances are equal if they agree in nine places. Queries go out in blocks of bounded size.
    """
    spark = index.spark
    rows = index.rows()
    rows = rows.where(where) if where is not None else rows
    counts = {r.cell: (r.n, r.near, r.far) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("reach").alias("near"), F.max("reach").alias("far")).collect()}
    kind, asked = rows.schema["id"].dataType.simpleString(), queries.schema[id_col].dataType.simpleString()
    d = index.centres.shape[1]
    found = None
    for ids, q in _blocks(queries.where(usable(vector_col) & (F.size(vector_col) == d)).select(id_col, vector_col), block):
        few = first_cells(index, q, counts, k if itself else k + 1)
        near = _top(_scan(rows, ids, q, few, k, kind, asked, itself), k).groupBy("query_id").agg(F.max("distance").alias("most"), F.count("*").alias("n"))
        # One row a query of this block: nothing further than its k-th so far is in the result.
        known = {r.query_id: (2 * max(0.0, r.most) + 1e-8) ** 0.5 for r in near.where(F.col("n") == k).collect()}
        bound = np.array([known.get(i, 2.1) for i in ids.tolist()])
        part = _scan(rows, ids, q, reached(index, q, counts, bound), k, kind, asked, itself)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {asked}, id {kind}, distance double, rank int")
    return _top(found, k)


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list = []

    def one() -> tuple[np.ndarray, np.ndarray]:
        x = np.array([r[1] for r in held], np.float64)
        return np.array([r[0] for r in held]), x / np.linalg.norm(x, axis=1, keepdims=True)

    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield one()
            held = []
    if held:
        yield one()


def _scan(rows: DataFrame, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, kind: str, asked: str, itself: bool) -> DataFrame:
    """(query_id, id, distance): of each batch of the wanted cells the k nearest to each query that wants the cell."""
    cells = np.nonzero(wanted.any(axis=0))[0].tolist()
    sent = rows.sparkSession.sparkContext.broadcast((ids, q, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wanted = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            cell, own, x = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2))
            for c in np.unique(cell):
                at, who = np.nonzero(cell == c)[0], np.nonzero(wanted[:, c])[0]
                for w in np.array_split(who, max(1, len(who) // 256)):
                    away = np.round(1 - q[w] @ x[at].T, 9)
                    if not itself:
                        away[ids[w][:, None] == own[at][None]] = np.inf
                    n = min(k, len(at))
                    cut = np.partition(away, n - 1, axis=1)[:, n - 1 : n]  # ties at the cut stay
                    r, j = np.nonzero((away <= cut) & (away < np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[w][r]), pa.array(own[at][j], b.schema.field(1).type), pa.array(away[r, j])], ["query_id", "id", "distance"])

    return rows.where(F.col("cell").isin(cells)).select("cell", "id", "vector").mapInArrow(run, f"query_id {asked}, id {kind}, distance double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
