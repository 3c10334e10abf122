"""Tables in the folder that all executors share, and connected components over them.

Nothing here uses localCheckpoint or a machine's own disk: a lost executor costs
a re-run of its tasks, never a re-run of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    A session of one machine without that setting gets a temporary folder, kept
    in its setting; a cluster without it is an error, as no machine's own folder
    is seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="morphmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, or with more underscores before it, such that df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: The kept tables of what runs in the ``written`` block around it; other threads have blocks of their own.
_kept: ContextVar[list[str] | None] = ContextVar("kept", default=None)


def keep(spark: SparkSession, path: str) -> None:
    """Leave a folder to a lazy result: it goes with the ``written`` block around it, or with the session's JVM."""
    if (block := _kept.get()) is not None:
        block.append(path)
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


@contextmanager
def written(spark: SparkSession):
    """A block in which results are computed and written; the tables they were kept in go at its end.

    That holds for results made inside of the block by its own thread or task. Those of other threads stay.
    """
    own: list[str] = []
    before = _kept.set(own)
    try:
        yield
    finally:
        _kept.reset(before)
        for path in own:
            delete(spark, path)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of a query that is run in the block go when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


class Scratch:
    """Written tables that end with a ``with`` block; kept ones stay as long as their lazy result needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def save(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """Write df as Parquet to the shared folder and read it back, which cuts its lineage; its shuffle files go at once."""
        path = shared_dir(self.spark, name)
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        if keep:
            _keep(self.spark, path)
        else:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table before the block ends."""
        roots = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in df.inputFiles()}
        for path in [p for p in self.paths if p.split(":", 1)[-1].lstrip("/") in roots]:
            self.paths.remove(path)
            delete(self.spark, path)


_keep = keep


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], held: str) -> DataFrame:
    """rows joined with the one row that groups, a saved table, has of their key; ``held`` is a key's number of rows.

    Keys of over a thousandth of all counted rows are 1000 at most, however large
    the tables are: their groups are broadcast, and their rows stay where they
    are. All other keys go through a plain equi-join of two exchanges, which
    Spark can split where a partition is large.
    """
    total = groups.agg(F.sum(held)).first()[0] or 0
    hot = F.col(held) * 1000 > total
    often = groups.where(hot)
    if not often.limit(1).count():
        return rows.join(groups, on)
    seldom = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(groups.where(~hot), on)
    return rows.join(F.broadcast(often), on).unionByName(seldom)


#: Edges that one task contracts; its memory is bounded by them.
LOCAL_EDGES = 300_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task to the stars of their components: (id, smallest id)."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up]
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    stars = [(i, find(i)) for i in root]
    stars = [x for x in stars if x[0] != x[1]]
    for k in range(0, len(stars), 50_000):
        part = stars[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of ``edges(a, b)``; the component is its smallest id.

    Each task first contracts a bounded number of edges to stars. If there are
    more edges than one task's, alternating large-star and small-star steps
    follow: each is an aggregate with map-side combine and an equi-join, so a
    vertex with very many neighbours is neither gathered in one task nor sent to
    the driver. One row of sums goes to the driver per round, to see whether
    anything changed.
    """

    def stats(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        side = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return side.union(low.toDF("a", "b")).distinct()

    own = scratch.save(edges.where("a <> b"), "links")
    tasks = -(-own.count() // LOCAL_EDGES)
    now = scratch.save(own.repartition(max(1, tasks)).mapInArrow(_contracted, "a long, b long"), "links")
    before = stats(now) if tasks > 1 else None
    for _ in range(max_rounds):
        if before is None:
            break
        new = scratch.save(small_star(large_star(now)), "links")
        scratch.drop(now)
        now, after = new, stats(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
