"""Operator 7: mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the point frac(i * golden ratio), which falls into one source's share of the
unit interval; its rank among the source's slots names the block of the source's shuffled words it
takes, over again once all are taken.  Every block has ``block`` words but a source's last one, and
the last slot of a source stops at its target, so each source meets its target to the word.

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating; a target stops at three
times its source's size and the excess goes to the others by weight.  There is a driver-side row per
source, as there is a weight per source; documents and slots are never gathered.
Null or empty texts have size 0 and are never taken.  Repeated rows count each.  Reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RANKED, Scratch, documents, ranked

WEIGHTS = (5, 2, 1)
#: Names of columns that are made here, in part for a while only.
USED = ("source_index", "name", "source_size", "target", "blocks", "turns", "short", "rank", "before", "row_key", "taken", "_h", *RANKED)
#: 2**64 divided by the golden ratio, as an odd number.
GOLDEN = 0x9E3779B97F4A7C15


def n_words(c):
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: list[float], most: float = 3) -> list[float]:
    """Shares of the whole by weight, none above ``most`` times its size, the excess reshared."""
    held: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest, total = sum(sizes) - sum(held.values()), sum(weights[i] for i in free)
        share = {i: rest * weights[i] / total for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            return [held.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        held |= {i: float(most * sizes[i]) for i in over}


def schedule(spark: SparkSession, slots: list[int], scratch: Scratch) -> DataFrame:
    """(source_index, slot, turn): source k has ``slots[k]`` turns, from 0, at its slots in order."""
    total = sum(slots)
    bounds = np.cumsum(np.array(slots, np.float64)) / max(total, 1)

    def draw(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            u = (i.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
            at = np.minimum(np.searchsorted(bounds, (u >> np.uint64(11)) * 2.0**-53, side="right"), len(slots) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0)], ["source_index", "slot"])

    n = int(total * 1.05) + 64 * len(slots)
    drawn = ranked(spark.range(n).mapInArrow(draw, "source_index int, slot long"), scratch, ["source_index"], ["slot"]).withColumnRenamed("rank", "turn")
    quota = spark.createDataFrame([(k, int(q)) for k, q in enumerate(slots)], "k int, quota long")
    drawn = drawn.join(F.broadcast(quota), F.col("source_index") == F.col("k")).where("turn < quota").select("source_index", "slot", "turn")
    # What a source still lacks after five in a hundred more points than slots comes at the end.
    got = drawn.groupBy("source_index").agg(F.count(F.lit(1)).alias("got"))
    late = quota.join(got, quota.k == got.source_index, "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    late = late.select(F.col("k").alias("source_index"), F.explode(F.sequence("got", F.col("quota") - 1)).alias("turn"))
    return drawn.unionByName(late.select("source_index", (F.lit(n) + F.col("turn")).alias("slot"), "turn"))


def mix(df: DataFrame, block: int = 1024, weights=WEIGHTS, most: float = 3, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size, target, ``taken``; takes).

    ``takes``: rows (row_key, slot, turn, cycle, first, last) saying that a slot takes words first..last-1 of a
    document; a cycle goes once through the source.  Columns of ``df`` that have names used here are replaced.
    """
    spark = df.sparkSession
    df = df.drop(*USED)
    scratch = scratch or Scratch(spark)
    found = sorted(((r["source"], r["size"]) for r in df.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [s for _, s in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most) if sum(sizes) else [0.0] * len(sizes)
    plan = []
    for k, ((name, size), t) in enumerate(zip(found, goal, strict=True)):
        want = min(int(t + 0.5), int(most * size))
        whole, rest = divmod(want, size) if size else (0, 0)
        blocks = -(-size // block)
        plan.append((k, name, size, t, blocks, whole * blocks + -(-rest // block), rest % block))
    table = F.broadcast(spark.createDataFrame(plan or [(0, None, 0, 0.0, 0, 0, 0)], "source_index int, name string, source_size long, target double, blocks long, turns long, short long"))
    turns = schedule(spark, [p[5] for p in plan], scratch) if plan and sum(p[5] for p in plan) else spark.createDataFrame([], "source_index int, slot long, turn long")
    turns = turns.join(table.drop("name"), "source_index").withColumn("block", F.expr("turn % blocks"))
    # The last turn of a source may stop short within its block.
    turns = turns.withColumn("stop", F.expr(f"CASE WHEN turn = turns - 1 AND short > 0 THEN short ELSE {block} END"))
    turns = turns.select("source_index", "block", "slot", "turn", F.expr("turn div blocks").alias("cycle"), "stop")

    docs = df.join(table, F.col("source").eqNullSafe(F.col("name"))).withColumn("_h", F.xxhash64(F.lit("shuffle"), "doc_id"))
    docs = ranked(docs, scratch, ["source_index"], ["_h", "doc_id", "size"], "size").withColumn("row_key", F.struct("source_index", "rank"))
    spans = docs.where("size > 0").select("source_index", "row_key", "before", "size", F.explode(F.expr(f"sequence(before div {block}, (before + size - 1) div {block})")).alias("block"))
    spans = spans.withColumn("a", F.expr(f"greatest(before, block * {block})")).withColumn("b", F.expr(f"least(before + size, (block + 1) * {block})"))
    takes = spans.join(turns, ["source_index", "block"]).withColumn("b", F.expr(f"least(b, block * {block} + stop)")).where("b > a")
    takes = takes.select("row_key", "slot", "turn", "cycle", (F.col("a") - F.col("before")).alias("first"), (F.col("b") - F.col("before")).alias("last"))
    taken = takes.groupBy("row_key").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = docs.join(taken, "row_key", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return out.drop("name", "blocks", "turns", "short", "_h", "source_index", "rank", "before"), takes


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs)[0].select("doc_id", "source", "size", "source_size", "target", "taken")
