"""Operator 2: best-fit packing with swap-based local search.

A piece's place depends on its length alone, and there are at most ``capacity`` lengths.  So the
driver packs the histogram of lengths (bounded by the capacity, whatever the corpus): bins with the
same content form one pattern with a multiplicity.  Best fit decreasing opens patterns; local search
then moves items, or exchanges one for one, two for one or one for two, from emptier to fuller
patterns, each step raising the sum of squared fills, until no two patterns allow an exchange.  Pieces get their
places by their rank among pieces of equal length.

Null texts are empty (one end token).  Repeated rows are packed once each.  Columns besides ``doc_id``
and ``text`` are not read.  An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, ranked, small_batches, tidy
from .tokens import encoder, forget, public_path


def best_fit(sizes: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best fit decreasing over a histogram: ``[(items of a bin, how many such bins)]``."""
    open_: dict[int, list[tuple[Counter, int]]] = {}

    def put(items: Counter, times: int) -> None:
        if times:
            open_.setdefault(capacity - sum(s * n for s, n in items.items()), []).append((items, times))

    for s in sorted(sizes, reverse=True):
        left = sizes[s]
        while left:
            room = min((r for r in open_ if r >= s), default=None)
            items, times = open_[room].pop() if room is not None else (Counter(), left)
            if room is not None and not open_[room]:
                del open_[room]
            each = min((capacity if room is None else room) // s, left)
            full = min(times, left // each)
            rest = left - full * each if full < times else 0
            put(items + Counter({s: each}), full)
            if rest:
                put(items + Counter({s: rest}), 1)
            if room is not None:
                put(items, times - full - (rest > 0))
            left -= full * each + rest
    return [x for at in open_.values() for x in at]


class Patterns:
    """Patterns of the search, and all that each can give back: nothing, an item or two."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[Counter] = []
        self.times: list[int] = []
        self.fill: list[int] = []
        self.seen: list[int] = []
        self.known: dict[tuple, int] = {}
        self.takes: list[tuple] = []
        self.n = 0
        #: Of each return: its sum and number of items, and the pattern.
        self.total, self.size, self.owner = (np.zeros(1024, np.int64) for _ in range(3))
        #: Of each pattern: its fill, and whether it is in use (2: more than once).
        self.full, self.alive = (np.zeros(1024, np.int64) for _ in range(2))

    def add(self, items: Counter, times: int, fill: int) -> None:
        key = tuple(sorted(items.items()))
        k = self.known.get(key)
        if k is None:
            k = self.known[key] = len(self.items)
            self.items.append(items)
            self.times.append(0)
            self.fill.append(fill)
            self.seen.append(0)
            takes = _few(items, [()]) if fill < self.capacity else []
            while len(self.total) < self.n + len(takes):
                self.total, self.size, self.owner = (np.concatenate([x, x]) for x in (self.total, self.size, self.owner))
            while len(self.full) <= k:
                self.full, self.alive = (np.concatenate([x, x]) for x in (self.full, self.alive))
            at = slice(self.n, self.n + len(takes))
            self.total[at], self.size[at], self.owner[at] = [sum(t) for t in takes], [len(t) for t in takes], k
            self.takes += takes
            self.n += len(takes)
        if not self.times[k]:
            # Again in use: others may have looked at it while it was not.
            self.seen = [0 if not self.times[k] and self.fill[j] <= fill else x for j, x in enumerate(self.seen)]
        if self.times[k] < 2 <= self.times[k] + times:
            self.seen[k] = 0
        self.times[k] += times
        self.full[k], self.alive[k] = fill, min(2, self.times[k])

    def remove(self, k: int, times: int) -> None:
        self.times[k] -= times
        self.alive[k] = min(2, self.times[k])

    def best(self, low: int) -> tuple[int, tuple, tuple] | None:
        """Of what raises a fuller pattern and empties ``low``, what moves most: (pattern, given, returned)."""
        at = np.arange(self.seen[low], self.n)
        own = self.owner[at]
        room = self.capacity - self.full[own]
        ok = (self.full[own] >= self.fill[low]) & (room > 0) & (self.alive[own] > (own == low))
        at, room = at[ok], room[ok]
        total, size = self.total[at], self.size[at]
        found = None
        for give in _few(self.items[low], []):
            gain = sum(give) - total
            ok = np.flatnonzero((gain > 0) & (gain <= room) & (size + len(give) <= 3))
            if len(ok):
                k = ok[np.lexsort((room[ok], -gain[ok]))[0]]
                if found is None or (gain[k], -room[k]) > found[0]:
                    found = ((gain[k], -room[k]), int(self.owner[at[k]]), give, self.takes[at[k]])
        if found is None:
            self.seen[low] = self.n
        return found and found[1:]


def _few(items: Counter, none: list[tuple]) -> list[tuple]:
    """One or two of some items."""
    return none + [(a,) for a in items] + [(a, b) for a in items for b in items if a < b or a == b and items[a] > 1]


def local_search(bins: list[tuple[Counter, int]], capacity: int) -> list[tuple[Counter, int]]:
    """Empty patterns into fuller ones, the emptiest first, until no exchange is left or no sequence can be saved.

    Each exchange raises the sum of squared fills, so the search ends."""
    total = sum(s * n * m for items, m in bins for s, n in items.items())
    least = -(-total // capacity)
    pool = Patterns(capacity)
    for items, m in bins:
        pool.add(items, m, sum(s * n for s, n in items.items()))
    count = sum(pool.times)
    moved = True
    while moved and count > least:
        moved = False
        for low in sorted((k for k, m in enumerate(pool.times) if m and pool.fill[k] < capacity), key=lambda k: pool.fill[k]):
            while pool.times[low] and count > least and (found := pool.best(low)):
                high, give, take = found
                times = min(pool.times[low], pool.times[high]) if high != low else pool.times[low] // 2
                gain = sum(give) - sum(take)
                a, b = pool.items[low] - Counter(give) + Counter(take), pool.items[high] - Counter(take) + Counter(give)
                fill = pool.fill[low] - gain, pool.fill[high] + gain
                pool.remove(low, times)
                pool.remove(high, times)
                if fill[0]:
                    pool.add(a, times, fill[0])
                else:
                    count -= times
                pool.add(b, times, fill[1])
                moved = True
    return sorted(((items, m) for items, m in zip(pool.items, pool.times, strict=True) if m), key=lambda x: sorted(x[0].items(), reverse=True), reverse=True)


def pack_histogram(sizes: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    return local_search(best_fit(sizes, capacity), capacity)


def places(bins: list[tuple[Counter, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, items a bin, offset in the bin)."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for items, m in bins:
        at = 0
        for s in sorted(items, reverse=True):
            rows.append((s, used[s], m * items[s], sequence, items[s], at))
            used[s] += m * items[s]
            at += s * items[s]
        sequence += m
    return rows


def token_pieces(df: DataFrame, path: str, capacity: int, end_id: int, drops_space: bool = False, with_ids: bool = False, most: int = 500_000, keep: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): whole documents, cut only beyond the capacity;
    of a document that is cut, the first piece takes what the full ones leave."""
    small_batches(df.sparkSession)

    def run(batches):
        try:
            yield from pieces(batches, encoder(path, drops_space, most))
        finally:
            if not keep:
                forget()

    def pieces(batches, enc):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = enc.encode(batch.column(1))
            end = np.array([end_id], ids[0].dtype)
            flat = np.concatenate([x for doc in ids for x in (doc, end)]).astype("<u4")
            size = np.array([len(x) + 1 for x in ids], np.int64)
            many = -(-size // capacity)
            doc = np.repeat(np.arange(len(ids)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            first = ((size - 1) % capacity + 1)[doc]
            start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first)
            at = ((np.cumsum(size) - size)[doc] + start) * 4
            raw = memoryview(flat).cast("B")
            bodies = [raw[a : a + n] for a, n in zip(at.tolist(), (length * 4).tolist(), strict=True)]
            cols = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, bodies)), pa.int64())]
            if with_ids:
                cols.append(pa.array(list(map(bytes, bodies)), pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return df.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int, scratch: Scratch | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``."""
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark)
    # Saved first: range bounds are sampled from it, which would tokenise everything twice.
    placed = ranked(scratch.save(pieces, "pieces"), scratch, ["length"], ["doc_id", "piece", "ids_crc32"])
    sizes = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    rows = places(pack_histogram(sizes, capacity))
    table = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "len long, lo long, many long, seq long, each long, at long")
    # A row of the table per length and pattern: bounded by the capacity, not by the corpus.
    inside = F.col("rank") - F.col("lo")
    out = placed.join(F.broadcast(table), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (inside < F.col("many")))
    out = out.withColumn("sequence_id", F.col("seq") + F.floor(inside / F.col("each"))).withColumn("offset", F.col("at") + (inside % F.col("each")) * F.col("length"))
    return out.drop("rank", "len", "lo", "many", "seq", "each", "at")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: (sequence_id, length, ids, doc_ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def pack_documents(df: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = 2, with_ids: bool = False, most: int = 500_000, keep: bool = True) -> DataFrame:
    """``most``: chunks that a worker remembers; ``keep``: beyond the end of a task."""
    return pack(token_pieces(df, path or public_path("byte_bpe_50k.json"), capacity, end_id, with_ids=with_ids, most=most, keep=keep), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
