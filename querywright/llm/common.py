"""Shared pieces: scratch tables in the cluster's shared folder, distributed ranks, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: the same numbers everywhere."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    path = os.path.join(tempfile.mkdtemp(prefix="qw-"), "querywright_ship.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "querywright").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows and bytes of one Arrow batch, since a batch of whole texts must fit in a Python worker.

    Plans are run later, so the session keeps the setting; a smaller one of the caller's stays."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 24)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def tidy(run):
    """A function for mapInArrow whose worker gives unused memory back at the end of each task.

    Workers live on between tasks, beside the executor's heap."""

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


class Scratch:
    """Tables written below ``spark.checkpoint.dir``, which every executor can read again.

    A written table cuts the lineage and survives the loss of an executor.  Where the setting is
    absent (tests on one machine) a temporary folder takes its place.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="qw-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/qw-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a saved table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Names of columns that ``ranked`` makes for a while; its caller must drop those of its input.
RANKED = ("_p", "_i", "_p2", "_n", "_v", "_first", "_rows", "_sum")


def ranked(df: DataFrame, scratch: Scratch, group: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Add ``rank`` (from 0) and, for ``value``, ``before`` (sum over earlier rows) within each group.

    No group meets in one task: rows are range-partitioned on group and order, counted per range and
    group, and only those counts (one row per range plus one per group) are summed up and sent back.
    """
    keys = [*group, *order]
    # Keys unknown to the sampling of the range bounds are sorted, so a hot group spreads by ``order``.
    dealt = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*keys)
    dealt = scratch.save(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranked")
    aggs = [F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first")]
    if value:
        aggs.append(F.sum(value).alias("_v"))
    parts = dealt.groupBy("_p", *group).agg(*aggs)
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_rows", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    if value:
        parts = parts.withColumn("_sum", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    parts = parts.select(F.col("_p").alias("_p2"), *[F.col(g).alias(f"_g_{g}") for g in group], "_first", "_rows", *(["_sum"] if value else []))
    cond = F.col("_p") == F.col("_p2")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = dealt.join(F.broadcast(parts), cond).withColumn("rank", F.col("_rows") + F.col("_i") - F.col("_first"))
    if value:
        inside = Window.partitionBy("_p", *group).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_sum") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        out = out.drop("_sum")
    return out.drop("_p", "_i", "_p2", "_first", "_rows", *[f"_g_{g}" for g in group])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, component_id)`` with the smallest id reached.

    Alternating large-star and small-star rounds: each round rewires every node to the smallest
    neighbour it knows.  A node's neighbourhood is only ever reduced by ``min``, joined back by key.
    """
    e = scratch.save(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a node meet its smallest neighbour
        big = both.join(low, "a").where("b > a").select(F.col("b"), F.col("m")).where("b <> m").select(F.col("m").alias("a"), F.col("b")).distinct()
        e2 = scratch.save(big, "edges")
        # small star: smaller neighbours of a node, and itself, meet its smallest neighbour
        low2 = e2.groupBy("b").agg(F.min("a").alias("m"))
        kin = e2.join(low2, "b")
        small = kin.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(low2.select(F.col("m").alias("a"), "b")).distinct()
        e3 = scratch.save(small, "edges")
        mark = e3.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        scratch.drop(e2)
        e = e3
        if mark == seen:
            break
        seen = mark
    links = e.select(F.col("b").alias("id"), F.col("a").alias("component_id"))
    return links.union(e.select(F.col("a").alias("id"), F.col("a").alias("component_id")).distinct())
