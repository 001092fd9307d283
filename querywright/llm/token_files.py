"""Operator 5: token ids in directly addressable codes.

Each id is split into chunks of ``width`` bits, lowest first.  Level k holds the k-th chunk of every
id that has one, a continuation bitmap saying which of them go on, and a rank directory with the ones
before each 512-bit block.  The i-th id is read by following ranks from level to level, so no
block is decoded.

A segment is one byte string: a header, the documents' ids and token counts, then the levels.
Segments are rows of a table that Spark's own writer commits, in ascending ``doc_id`` order, so any
store that Spark can write will do and lost tasks leave nothing behind.

Null texts are empty (the end id alone).  Repeated doc_ids are kept, ordered by their bytes; rows
without one come first.  An empty table gives an empty file.  Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches, tidy
from .tokens import crc_of, encoder, public_path

MAGIC = b"QWDAC001"
#: Stands for a null doc_id in a segment.
NO_DOC = -(1 << 63)
BLOCK = 512


def encode_levels(ids: np.ndarray, width: int = 8) -> bytes:
    out, rest = [], ids.astype(np.uint64)
    while True:
        low = (rest & np.uint64((1 << width) - 1)).astype(np.uint16 if width > 8 else np.uint8)
        more = rest >> np.uint64(width)
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-max(1, len(on)) // BLOCK) * BLOCK, bool)
        padded[: len(on)] = on
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1))[:-1]]).astype("<u4")
        out.append(struct.pack("<IIII", len(low), low.nbytes, bits.nbytes, ranks.nbytes) + low.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = more[on]
        if not len(rest):
            return struct.pack("<BB", width, len(out)) + b"".join(out)


class Levels:
    """Random access to the ids of ``encode_levels``."""

    def __init__(self, data: bytes | memoryview):
        self.width, n = struct.unpack_from("<BB", data)
        self.levels, at = [], 2
        for _ in range(n):
            count, a, b, c = struct.unpack_from("<IIII", data, at)
            at += 16
            low = np.frombuffer(data, np.uint16 if self.width > 8 else np.uint8, count, at)
            bits = np.frombuffer(data, np.uint8, b, at + a)
            ranks = np.frombuffer(data, "<u4", c // 4, at + a + b)
            self.levels.append((low, bits, ranks))
            at += a + b + c

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, i: int) -> int:
        """The i-th id alone: one chunk, one bit and one rank a level."""
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (k * self.width)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK * BLOCK
            before = np.unpackbits(bits[block >> 3 : (i >> 3) + 1], bitorder="little")[: i - block]
            i = int(ranks[i // BLOCK]) + int(before.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id in order."""
        value = np.zeros(len(self), np.uint32)
        at = np.arange(len(self))
        for k, (low, bits, _) in enumerate(self.levels):
            value[at] |= low.astype(np.uint32) << np.uint32(k * self.width)
            at = at[np.unpackbits(bits, bitorder="little")[: len(low)].astype(bool)]
        return value


def write_segment(docs: list[int], ids: list[np.ndarray], width: int = 8) -> bytes:
    counts = np.array([len(x) for x in ids], "<u4")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return MAGIC + struct.pack("<I", len(docs)) + np.array([NO_DOC if d is None else d for d in docs], "<i8").tobytes() + counts.tobytes() + encode_levels(flat, width)


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, Levels]:
    if data[:8] != MAGIC:
        raise ValueError("not a token segment")
    (n,) = struct.unpack_from("<I", data, 8)
    return np.frombuffer(data, "<i8", n, 12), np.frombuffer(data, "<u4", n, 12 + 8 * n), Levels(memoryview(data)[12 + 12 * n :])


def grouped(batches, most: int = 1 << 24):
    """Batches put together up to ``most`` bytes: words of several batches are looked up once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if held and size + b.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def write_tokens(df: DataFrame, out: str, path: str, end_id: int, drops_space: bool, width: int = 8, segment: int = 1 << 20) -> None:
    """Encode ``df(doc_id, text)`` and write segments of about ``segment`` ids in ascending doc_id order."""
    spark = df.sparkSession
    small_batches(spark)
    # Ranges of doc_id from quantiles of that column alone, so that no text is encoded twice.
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = [k / parts for k in range(1, parts)]
    known = df.agg(F.percentile_approx("doc_id", steps, 100 * parts), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    bounds = np.unique(np.array(known[0] or [], np.int64))
    # Rows without a doc_id come before all others, dealt to parts of their own.
    free = parts if known[1] else 0

    def tokenise(batches):
        enc = encoder(path, drops_space)
        for b in grouped(batches):
            part = np.searchsorted(bounds, b.column(0).fill_null(NO_DOC).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
            end = np.array([end_id], enc.dtype).tobytes()
            ids = [x.tobytes() + end for x in enc.encode(b.column(1))]
            part += free
            for i in np.flatnonzero(b.column(0).is_null().to_numpy(zero_copy_only=False)).tolist():
                part[i] = zlib.crc32(ids[i]) % free
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([enc.dtype.itemsize] * len(ids), pa.int32()), pa.array(part)], ["doc_id", "ids", "wide", "part"])

    def segments(batches):
        docs: list = []
        ids: list[np.ndarray] = []
        held = number = 0
        part = None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([write_segment(docs, ids, width)], pa.binary())], ["part", "number", "tokens", "segment"])

        for b in batches:
            for d, x, wide, p in zip(*[b.column(k) if k == 1 else b.column(k).to_pylist() for k in range(4)], strict=True):
                x = np.frombuffer(x.as_buffer(), f"<u{wide}")
                if docs and (p != part or held + len(x) > segment):
                    yield flush()
                    docs, ids, held, number = [], [], 0, number + 1
                part = p
                docs.append(d)
                ids.append(x)
                held += len(x)
        if docs:
            yield flush()

    tokens = df.select("doc_id", "text").mapInArrow(tidy(tokenise), "doc_id long, ids binary, wide int, part int")
    # Task k has part k, so the files are in the order of doc_id too.
    dealt = tokens.repartitionById(free + len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(segments, "part int, number int, tokens long, segment binary").write.option("compression", "uncompressed").parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the segments: doc_id, start, n_tokens, ids_crc32, ids (as little-endian u4)."""
    files = spark.read.parquet(path)
    # A row per segment (about a million ids): their running sum needs no row of a document.
    order = Window.partitionBy(F.lit(0)).orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "number", "tokens").withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0))).drop("tokens")

    def read(batches):
        for b in batches:
            for data, base in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                docs, counts, levels = read_segment(data.as_buffer().to_pybytes())
                flat, ends = levels.all(), np.cumsum(counts, dtype=np.int64)
                parts = [flat[e - c : e] for e, c in zip(ends, counts.astype(np.int64), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=docs == NO_DOC), pa.array(base + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([crc_of(x) for x in parts], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    placed = files.join(F.broadcast(starts), ["part", "number"])
    return placed.select("segment", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark).path("tokens")
    write_tokens(documents(spark, sf_dir), out, public_path("word_bpe_49k.json"), 1, True)
    return read_tokens(spark, out).drop("ids")
