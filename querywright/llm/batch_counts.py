"""Which tokens of each document other documents hold too, counted over all documents.

Texts go by in batches.  A batch sends each of its tokens once to where all its counts meet, with the documents that
hold it, and gets back the tokens that two documents hold, with how many do.  Tokens that many documents of a batch
hold are sent without these, so a common token weighs a row a batch.  Tokens are dealt to slices of the hash range,
which a task takes one at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import small_batches, tidy

#: Tokens of a batch, and from how many of its documents on a token is sent without them.
BATCH, COMMON = 600_000, 64


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each compressed where that helps."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    out = []
    for a in arrays:
        raw = a.tobytes()
        small = pack(raw)
        helps = len(small) < len(raw)
        body = small if helps else raw
        out.append(struct.pack("<4sBI", a.dtype.str.encode(), helps, len(body)) + body)
    return b"".join(out)


def unpacked(body) -> list[np.ndarray]:
    import zstandard

    unpack, out, at = zstandard.ZstdDecompressor().decompress, [], 0
    while at < len(body):
        kind, small, n = struct.unpack_from("<4sBI", body, at)
        raw = body[at + 9 : at + 9 + n]
        out.append(np.frombuffer(unpack(raw) if small else raw, kind.rstrip(b"\0").decode()))
        at += 9 + n
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max(initial=0))
    return a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def gaps(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens as low and high halves of their differences."""
    d = np.diff(tokens, prepend=np.uint64(0))
    return d.astype("<u4"), narrow(d >> np.uint64(32))


def joined_gaps(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.cumsum(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), dtype=np.uint64)


def planes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a & 255).astype("<u1"), narrow(a >> 8)


def starts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


_SENT = pa.schema([("slice", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])


class Sender:
    """Documents of a batch and their tokens; with ``once`` documents of equal digest send those of the first."""

    def __init__(self, part: int, slices: int, once: bool):
        self.part, self.slices, self.once, self.number = part, slices, once, 0
        self.clear()

    def clear(self) -> None:
        self.docs, self.sizes, self.digests, self.sets, self.owners, self.seen, self.n = [], [], [], [], [], set(), 0

    def add(self, doc: int | None, size: int, digest: bytes, tokens: np.ndarray) -> None:
        """``tokens``: sorted, distinct, of 56 bits; those of a null doc_id are not sent."""
        if doc is not None and len(tokens) and not (self.once and digest in self.seen):
            self.seen.add(digest)
            self.sets.append(tokens)
            self.owners.append(len(self.docs))
            self.n += len(tokens)
        self.docs.append(doc)
        self.sizes.append(size)
        self.digests.append(digest)

    def flush(self) -> pa.RecordBatch:
        """Row of kind 0: documents, and those of common tokens; of kind 1: tokens of a slice of the hash range."""
        tokens = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        who = np.repeat(np.array(self.owners, np.int64), [len(s) for s in self.sets])
        order = np.argsort(tokens, kind="stable")
        tokens, who = tokens[order], who[order]
        at = starts(tokens)
        many = np.diff(np.append(at, len(tokens)))
        common = many >= COMMON
        inline = np.repeat(~common, many)
        tokens = tokens[at]
        batch = self.part << 32 | self.number
        known = np.array([d is not None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        head = packed(docs, known, np.array(self.sizes, "<i8"), np.frombuffer(b"".join(self.digests), np.uint8), tokens[common], many[common], narrow(who[~inline]))
        rows = [(batch % self.slices, 0, head)]
        slices = ((tokens >> np.uint64(24)) * np.uint64(self.slices) >> np.uint64(32)).astype(np.int64)
        cuts = np.append(starts(slices), len(slices))
        held = who[inline]
        ends = np.concatenate([[0], np.cumsum(np.where(common, 0, many))])
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows.append((int(slices[a]), 1, packed(*gaps(tokens[a:b]), narrow(many[a:b]), *planes(held[ends[a] : ends[b]]))))
        self.number += 1
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([batch] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=_SENT)


def counted(rows: list[tuple[int, bytes]]):
    """Rows (batch, kind, body) of one slice: of each batch its tokens that two documents hold, with how many do."""
    bodies = [unpacked(body) for _, body in rows]
    tokens = [joined_gaps(b[0], b[1]) for b in bodies]
    flat = np.concatenate(tokens)
    many = np.concatenate([b[2] for b in bodies]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    at = starts(flat[order])
    held = np.empty(len(flat), np.int64)
    held[order] = np.repeat(np.add.reduceat(many[order], at), np.diff(np.append(at, len(flat))))
    done = 0
    for (batch, _), b, t in zip(rows, bodies, tokens, strict=True):
        df, n = held[done : done + len(t)], b[2].astype(np.int64)
        done += len(t)
        keep = df > 1
        if keep.any():
            inside = np.repeat(keep, np.where(n >= COMMON, 0, n))
            yield batch, 1, packed(*gaps(t[keep]), narrow(df[keep]), b[2][keep], b[3][inside], b[4][inside])


def regrouped(head: list[np.ndarray], parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch the tokens that come back, by document and from rare to common, and how many each document has."""
    docs, _, _, _, common, common_n, common_docs = head
    parts = sorted(parts, key=lambda p: (int(p[1][0]), int(p[0][0])))  # by first token: slices are ranges
    tokens = np.concatenate([np.zeros(0, np.uint64), *[joined_gaps(p[0], p[1]) for p in parts]])
    df = np.concatenate([np.zeros(0, np.int64), *[p[2].astype(np.int64) for p in parts]])
    many = np.concatenate([np.zeros(0, np.int64), *[p[3].astype(np.int64) for p in parts]])
    inline = np.concatenate([np.zeros(0, np.int64), *[p[4].astype(np.int64) | p[5].astype(np.int64) << 8 for p in parts]])
    few = many < COMMON  # the others are those of the head, in the same order
    t = np.concatenate([np.repeat(tokens[few], many[few]), np.repeat(common, common_n)])
    d = np.concatenate([np.repeat(df[few], many[few]), np.repeat(df[~few], common_n)])
    who = np.concatenate([inline, common_docs.astype(np.int64)])
    return t[np.lexsort((t, d, who))], np.bincount(who, minlength=len(docs))


def batch_slices(spark) -> int:
    return 16 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_tokens(df: DataFrame, tokens_of: Callable, gathered: Callable[[list, list], pa.RecordBatch], schema: str, once: bool = False) -> DataFrame:
    """What ``gathered(head, parts)`` makes of each batch of ``df(doc_id, text)``; ``tokens_of(text)`` gives size, digest, tokens."""
    spark = df.sparkSession
    small_batches(spark)
    slices = batch_slices(spark)

    def send(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        to = Sender(TaskContext.get().partitionId(), slices, once)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                to.add(doc, *tokens_of(text.as_py()))
                if to.n >= BATCH or len(to.docs) >= 1 << 16:
                    yield to.flush()
        if to.docs:
            yield to.flush()

    def meet(batches: Iterable[pa.RecordBatch]):
        def settle(rows):
            rows = list(counted(rows)) if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SENT)[1:], strict=True)], schema=pa.schema(list(_SENT)[1:]))

        rows, now = [], None
        for b in batches:
            heads = b.filter(pa.compute.equal(b.column(2), 0))
            if heads.num_rows:
                yield heads.select(["batch", "kind", "body"])
            for s, batch, kind, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    continue
                if s != now:
                    yield from settle(rows)
                    rows, now = [], s
                rows.append((batch, body))
        yield from settle(rows)

    def gather(batches: Iterable[pa.RecordBatch]):
        head, parts, now = None, [], None
        for b in batches:
            for batch, _, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if batch != now:
                    if head:
                        yield gathered(head, parts)
                    head, parts, now = unpacked(body), [], batch
                else:
                    parts.append(unpacked(body))
        if head:
            yield gathered(head, parts)

    sent = df.select("doc_id", "text").mapInArrow(tidy(send), "slice int, batch long, kind int, body binary")
    met = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(tidy(meet), "batch long, kind int, body binary")
    return met.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(tidy(gather), schema)
