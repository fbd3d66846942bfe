"""Shared folders, Arrow helpers and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Keys with more than one in so many of a table's rows are hot: there can be so many of them at most.
HOT = 1000
#: Bits of the map that parted() sends out, 64 to a row: what is broadcast stays below some megabytes, however many keys there are.
BITS = 1 << 23
#: Settings of a session that the operators give it where it has none of its own: a query's shuffle files go when
#: it ends (what saved() wrote needs them no more), and Python gets texts in batches of bounded size.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216b"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent (local tests) a temporary folder is set once per session.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("folioframe.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("folioframe.shared.dir", found)
    return found


def settled(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


#: What saved() has written inside the innermost scratch().
_written: ContextVar[list[DataFrame] | None] = ContextVar("_written", default=None)


def saved(df: DataFrame, name: str, *, kept: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of executors.

    kept: a scratch() around it leaves the table where it is.
    """
    spark = settled(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not kept and (own := _written.get()) is not None:
        own.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that saved() writes inside are deleted at the end, but for kept ones: nothing may read them later."""
    own: list[DataFrame] = []
    before = _written.set(own)
    try:
        yield
    finally:
        _written.reset(before)
        for df in own:
            dropped(df)


def dropped(df: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:  # none for a table that is gone already
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of bounded size; a worker gives back what a task took before it takes the next."""
    settled(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def strips(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Columns of numbers without nulls, about `rows` rows at a time."""
    held, n = [], 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        n += b.num_rows
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def spread_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """big.join(small, on) for unique keys that stand in `weight` rows of big each, `total` in all.

    Keys of more than a HOT-th of the rows, HOT of them at most, are broadcast, so that none fills a task.
    """
    hot = F.broadcast(small.where(F.col(weight) > total / HOT).drop(weight))
    rest = big.join(hot.select(*on), on, "left_anti").join(small.where(F.col(weight) <= total / HOT).drop(weight), on)
    return big.join(hot, on).unionByName(rest)


def parted(big: DataFrame, small: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """big in two: the rows whose keys `on` may stand in small, every one that does among them, and those whose keys don't.

    A key sets one of BITS bits by its hash; nulls are keys like any other. A join of the first part with
    small then shuffles about what it finds and not all of big; as keys fill the map the first part grows.
    """
    h = F.xxhash64(*on)
    word, bit = F.pmod(F.shiftrightunsigned(h, 6), F.lit(BITS // 64)), h.bitwiseAND(F.lit(63)).cast("int")
    own = small.select(*[F.col(c).cast(big.schema[c].dataType).alias(c) for c in on])
    set_bits = own.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    found = F.broadcast(set_bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    both = big.join(found, word == F.col("_word"), "left")
    may = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return both.where(may).select(big.columns), both.where(~may).select(big.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list of longs.

    Alternates large-star and small-star steps: every step is one grouped minimum and one join, so
    that no task holds a whole component; each round is written to the shared folder. Returns (node,
    root) for the nodes that have an edge to another node. Self-loops and repeated edges do no harm.
    """
    e = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        old, e = e, saved(small.where("u > v").distinct(), "stars")
        dropped(old)
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if before == now:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        before = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
