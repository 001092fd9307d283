"""Operator 1: Hilbert-curve shards.

Metadata columns are quantised to a few bits each, the cell's index on a Hilbert curve orders the
rows, and equal runs of that order become shards, so rows of a shard are near in every dimension and
a reader can skip shards by their minima and maxima.  DataFrame functions only.

Nulls quantise to cell 0.  Ties on the curve are ordered by the ``tie`` columns, so reruns agree up
to rows that are equal in all of them.  An empty table gives an empty result.  Columns of the input
with names made here (``hilbert``, ``rank``, ``shard``, ``slot`` and inner ones) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RANKED, Scratch, documents, ranked


def string_code(c: Column, shared: int) -> Column:
    """Order-preserving number of a string: the seven bytes that follow the ``shared`` first ones."""
    tail = F.substring(F.hex(F.encode(c, "UTF-8")), 2 * shared + 1, 14)
    return F.conv(F.rpad(tail, 14, "0"), 16, 10).cast("long")


def shared_prefix(low: str | None, high: str | None) -> int:
    """Bytes that all values between two strings share."""
    a, b = (low or "").encode(), (high or "").encode()
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def quantise(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Add ``q``: for each dimension its cell, cut at approximate quantiles of all rows."""
    kinds = dict(df.dtypes)
    strings = [d for d in dims if kinds[d] == "string"]
    ends = df.agg(*[f(d).alias(f"{n}_{d}") for d in strings for n, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n")).first()
    codes = {d: string_code(F.col(d), shared_prefix(ends[f"lo_{d}"], ends[f"hi_{d}"])) if d in strings else F.col(d).cast("double") for d in dims}
    steps = [i / 2**bits for i in range(1, 2**bits)]
    cuts = df.agg(*[F.percentile_approx(codes[d], steps, 10_000).alias(d) for d in dims]).first()
    cells = []
    for d in dims:
        at = sorted(set(cuts[d] or []))
        known = F.array(*[F.lit(x) for x in at]) if at else F.array().cast("array<double>")
        code = codes[d]
        # A null code fails every comparison and stays in cell 0.
        cells.append(F.coalesce(F.size(F.filter(known, lambda x: x <= code)), F.lit(0)).cast("long"))  # noqa: B023
    return df.withColumn("q", F.array(*cells))


def hilbert_index(q: str, dims: int, bits: int) -> Column:
    """Index on the Hilbert curve of column ``q``, an array of ``dims`` numbers of ``bits`` bits.

    From the highest bit down, an axis with that bit set mirrors the lower bits of the first axis, and
    any other swaps them with the first; a Gray code across the axes and a last flip give the
    index, bit by bit."""
    axes = f"sequence(0, {dims - 1})"
    shifts = f"sequence({bits - 1}, 1, -1)" if bits > 1 else "cast(array() as array<int>)"
    low = "(shiftleft(1L, s) - 1)"
    turn = f"""transform(x, (v, j) -> CASE
        WHEN (x[i] & shiftleft(1L, s)) <> 0 THEN IF(j = 0, v ^ {low}, v)
        WHEN j = 0 OR j = i THEN v ^ ((x[0] ^ x[i]) & {low})
        ELSE v END)"""
    unfolded = f"aggregate({shifts}, {q}, (y, s) -> aggregate({axes}, y, (x, i) -> {turn}))"
    gray = f"transform({axes}, k -> aggregate(slice(u, 1, k + 1), 0L, (g, v) -> g ^ v))"
    flip = f"aggregate({shifts}, 0L, (t, s) -> IF((g[{dims - 1}] & shiftleft(1L, s)) <> 0, t ^ {low}, t))"
    bits_of = f"aggregate(sequence({bits - 1}, 0, -1), 0L, (h, s) -> aggregate(g, h, (a, v) -> a * 2 + (shiftright(v ^ f, s) & 1L)))"
    # One-element arrays name the steps, so that none is written out twice.
    return F.expr(f"transform(transform(transform(array({unfolded}), u -> {gray}), g -> struct(g, {flip} AS f)), w -> transform(array(w.f), f -> transform(array(w.g), g -> {bits_of})[0])[0])[0]")


def hilbert_shards(df: DataFrame, dims: list[str], tie: list[str], shards: int = 16, bits: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """Rows with ``hilbert``, ``rank`` on the curve, ``shard`` (counts at most one apart) and ``slot``."""
    scratch = scratch or Scratch(df.sparkSession)
    df = df.drop(*(c for c in ("q", "hilbert", "rank", "shard", "slot", *RANKED) if c not in dims + tie))
    cells = quantise(df, dims, bits).withColumn("hilbert", hilbert_index("q", len(dims), bits)).drop("q")
    out = ranked(cells, scratch, [], ["hilbert", *tie])
    n = out.agg(F.count(F.lit(1))).first()[0]
    # The first n mod shards runs hold one row more than the others.
    each, more = divmod(n, shards)
    cut = more * (each + 1)
    late = F.col("rank") - cut
    shard = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (each + 1))).otherwise(more + (F.floor(late / each) if each else F.lit(0)))
    slot = F.when(F.col("rank") < cut, F.col("rank") % (each + 1)).otherwise(late % each if each else F.lit(0))
    return out.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard its rows and the least and greatest value of each dimension, for pruning."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its files in slot order: a shard is written by as many tasks as its rows need."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by law ``rows``; a null text counts as empty with crc 0."""
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", F.col("source").alias("source"), F.col("lang").alias("lang"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = hilbert_shards(docs, ["source", "lang", "size", "doc_id"], ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
