"""Operator 6: nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and files them under the nearest signed axis.  A query probes, in every table, the signed
axes nearest to it; candidates are scored exactly, in double precision, on the original vectors.

The number of probes is fitted: for up to ``sample`` queries the true neighbours are found against all
rows, and the fewest probes are taken that reach ``recall`` of them.  Every row is indexed.
Vectors of unequal norms get one more coordinate that makes all norms equal, which turns the largest
inner product into the nearest direction.

Equal vectors are one entry that lists its k + 1 smallest ids: no later id can be among a query's k
nearest.  A bucket beyond ``chunk`` entries is split, and its queries go to every part.
Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part.  Rows with the query's own vec_id are no candidates.  Ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of rows whose width is a power of two."""
    d = x.shape[1]
    x = x.copy()
    for k in range(3):
        x *= np.random.Generator(np.random.PCG64([table, k])).integers(0, 2, d) * 2 - 1
        h = 1
        while h < d:
            y = x.reshape(len(x), d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), d)
            h *= 2
        x /= np.sqrt(d)
    return x


def widen(x: np.ndarray, reach: float | None) -> np.ndarray:
    """Unit vectors padded to a power of two; ``reach``: the largest norm if norms differ (0 for queries)."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    if reach is None:
        x = x / np.maximum(n, 1e-300)
    elif reach == 0:
        x = np.concatenate([x / np.maximum(n, 1e-300), np.zeros((len(x), 1))], 1)
    else:
        x = np.concatenate([x, np.sqrt(np.maximum(reach**2 - n**2, 0))], 1) / reach
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


def axis_of(y: np.ndarray) -> np.ndarray:
    a = np.abs(y).argmax(1)
    return 2 * a + (y[np.arange(len(y)), a] < 0)


def probe_order(y: np.ndarray) -> np.ndarray:
    """All signed axes of each row, nearest first."""
    return np.argsort(-np.stack([y, -y], 2).reshape(len(y), -1), axis=1, kind="stable")


def matrix(column) -> np.ndarray:
    return np.array(column.to_list() if hasattr(column, "to_list") else column.to_pylist(), np.float64)


def entries(df: DataFrame, every: int, k: int) -> DataFrame:
    """Distinct vectors: (entry, v, members, asks): the k + 1 smallest ids and the ids that are queries."""
    v = F.col("embedding")
    sizes = df.where(v.isNotNull()).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = sizes["d"] if sizes else 0
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = df.where(v.isNotNull() & (F.size(v) == dims) & ~bad).where(F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v")).distinct()
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    first = ok.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    kept = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    return kept.withColumn("entry", F.element_at("members", 1).cast("long")).withColumn("e", F.xxhash64("v")), ok.where(F.pmod("vec_id", F.lit(every)) == 0)


def nearest(df: DataFrame, k: int = 20, every: int = 20, tables: int = 8, recall: float = 0.96, sample: int = 64, chunk: int = 8192, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows of ``df(vec_id, embedding)`` whose vec_id ``every`` divides."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    kept, asks = entries(df, every, k)
    kept = scratch.save(kept, "entries")
    asks = scratch.save(asks, "asks")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norms = kept.select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("n")).agg(F.min("n"), F.max("n")).first()
    if norms[0] is None:
        return empty
    reach = None if norms[1] <= norms[0] * (1 + 1e-6) else float(norms[1])
    # Queries with the same vector are one question.
    questions = scratch.save(asks.groupBy("v").agg(F.min("vec_id").alias("question")).select("question", "v"), "questions")
    probes = fit_probes(kept, questions, k, tables, recall, sample, reach)

    def file(batches):
        for b in batches:
            x = widen(matrix(b.column(1)), reach)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t] * len(x), pa.int32()), pa.array(axis_of(rotate(x, t)).astype(np.int32))], ["entry", "v", "t", "axis"])

    def probe(batches):
        for b in batches:
            x = widen(matrix(b.column(1)), None if reach is None else 0)
            for t in range(tables):
                at = probe_order(rotate(x, t))[:, :probes].astype(np.int32)
                rep = pa.array(np.repeat(np.arange(len(x)), at.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rep), b.column(1).take(rep), pa.array([t] * len(rep), pa.int32()), pa.array(at.ravel())], ["question", "v", "t", "axis"])

    kind = dict(kept.dtypes)["v"]
    filed = kept.select("entry", "v").mapInArrow(file, f"entry long, v {kind}, t int, axis int")
    # Entries per bucket: a row for each table and signed axis, however many vectors there are.
    parts = filed.groupBy("t", "axis").agg(F.count(F.lit(1)).alias("n")).select("t", "axis", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    parts = F.broadcast(scratch.save(parts, "buckets"))
    filed = filed.join(parts, ["t", "axis"]).withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
    asked = questions.mapInArrow(probe, f"question long, v {kind}, t int, axis int").join(parts, ["t", "axis"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def score(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"question": [], "entry": [], "score": []})
        ids, rows = x["entry"].to_numpy(np.int64), matrix(x["v"])
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        out = []
        for a in range(0, len(q), 512):
            s = matrix(q["v"].iloc[a : a + 512]) @ rows.T
            if s.shape[1] > 4 * (k + 1):
                # all that reach the (k+1)-th score, so that ties are cut by id below
                least = -np.partition(-s, k, axis=1)[:, k : k + 1]
                i, j = np.nonzero(s >= least)
            else:
                i, j = (z.ravel() for z in np.indices(s.shape))
            o = np.lexsort((ids[j], -s[i, j], i))
            i, j = i[o], j[o]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place <= k], j[place <= k]
            out.append(pd.DataFrame({"question": q["question"].to_numpy()[a + i], "entry": ids[j], "score": s[i, j]}))
        return pd.concat(out)

    keys = ["t", "axis", "part"]
    found = asked.select(*keys, "question", "v").groupBy(*keys).cogroup(filed.select(*keys, "entry", "v").groupBy(*keys)).applyInPandas(score, "question long, entry long, score double")
    found = found.groupBy("question", "entry").agg(F.max("score").alias("score"))
    order = Window.partitionBy("question").orderBy(F.desc("score"), "entry")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    listed = best.join(kept.select("entry", "members"), "entry").select("question", "score", F.explode("members").alias("vec_id"))
    short = listed.withColumn("r", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = short.groupBy("question").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("list"))
    who = asks.join(questions.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select(F.col("vec_id").alias("query_id"), "question")
    rows = who.join(lists, "question").select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("p", "x"))
    return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def fit_probes(kept: DataFrame, questions: DataFrame, k: int, tables: int, recall: float, sample: int, reach: float | None) -> int:
    """Fewest probes a table that find ``recall`` of the true neighbours of ``sample`` queries."""
    q = questions.orderBy(F.xxhash64("question")).limit(sample).toPandas()
    if not len(q):
        return 1
    x = matrix(q["v"])

    def best(batches):
        for b in batches:
            ids, rows = b.column(0).to_numpy(), matrix(b.column(1))
            s = x @ rows.T
            for i in range(len(x)):
                top = np.argsort(-s[i], kind="stable")[: k + 1]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(top), pa.int32()), pa.array(ids[top]), pa.array(s[i, top]), b.column(1).take(pa.array(top))], ["i", "entry", "score", "v"])

    kind = dict(kept.dtypes)["v"]
    true = kept.select("entry", "v").mapInArrow(best, f"i int, entry long, score double, v {kind}")
    # sample * (k + 1) rows
    true = true.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "entry"))).where(F.col("r") <= k + 1).toPandas()
    y, z = widen(matrix(true["v"]), reach), widen(x, None if reach is None else 0)
    i = true["i"].to_numpy()
    need = np.full(len(true), 1 << 30)
    for t in range(tables):
        order = probe_order(rotate(z, t))
        place = np.argsort(order, axis=1)
        need = np.minimum(need, place[i, axis_of(rotate(y, t))] + 1)
    return int(np.quantile(need, recall, method="higher"))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
