"""Operator 4: n-gram Jaccard join over count vectors.

A document is its set of distinct 5-word shingles, as 56-bit hashes.  Shingles are hashed into groups; the counts per
group are a point, and the overlap of two sets is at most the sum of the coordinate minima of their points.  Boxes
of an R-tree over the points are compared by that bound, and pairs of points that it allows are verified on the sets.

One tree over all points would hold each box against nearly every other, so documents are first told apart exactly:

1. How many documents hold a shingle is counted over all of them.  Texts go by in batches; a batch sends each of its
   shingles once to where all its counts meet, and gets back those that two documents hold.  Shingles that many
   documents of a batch hold are sent without their documents, so a common one weighs a row a batch.
2. What two linked sets share is at least four fifths of either, so a document with fewer shared shingles is
   linked with nothing.  In the rest, rarest shingles first, two linked sets have one of their first a - ceil(4a/5) + 1
   in common (the prefix principle), which leaves common passages out.
3. Documents that those first shingles connect, directly or through others, are a family; links lie within families.
   Each family is one block, or several of bounded rows and bytes that are held against each other
   in pairs; one of more than ``whole`` blocks falls apart by first shingle.  In each pair of blocks the tree runs, pairs
   already connected there are passed over, and what it verifies as linked becomes one edge: edges grow with the
   documents, not with pairs.

Components of the edges are the result.  Equal sets stand for their smallest doc_id.  Words are split at ASCII white
space after lower-casing A-Z.  Null and empty texts have no set and no link; they and rows with a null doc_id keep
their own doc_id as component.  Rows that repeat a doc_id are one node with the links of all their sets: they are
numbered, joined by number, and tied together afterwards.  An empty table gives an empty result.  Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batch_counts import gaps, joined_gaps, packed, regrouped, shared_tokens, unpacked
from .common import Scratch, components, distinct, documents, mixed, tidy

WORDS, GROUPS = 5, 512
_PLACES = mixed(np.arange(64) + 77) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 56-bit hashes of the shingles of a text; of one with fewer words, of all its words as one."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(w) < words:
        s = np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(w))], np.uint64)
    else:
        s = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            s += h[k : len(h) - words + 1 + k] * _PLACES[k]
    return distinct(mixed(s) >> np.uint64(8))


def counts(h: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The count vector of a set."""
    return np.bincount((h % np.uint64(groups)).astype(np.int64), minlength=groups)


def needed(n):
    """How many shingles of a set of ``n`` must be in every set it is linked with."""
    return (4 * n + 4) // 5


_DOC = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("tokens", pa.binary()), ("first", pa.list_(pa.int64()))])


def gathered(head: list[np.ndarray], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """A row for each document of a batch; ``tokens``, its shared shingles, and ``first``, the rarest, where it may be linked."""
    docs, known, sizes, digests = head[:4]
    t, shared = regrouped(head, parts)
    ends = np.cumsum(shared)
    left = np.where(sizes > 0, shared - needed(sizes) + 1, 0)
    sets: list = [None] * len(docs)
    first: list = [None] * len(docs)
    for k in np.flatnonzero(left > 0).tolist():
        own = t[ends[k] - shared[k] : ends[k]]
        first[k] = own[: left[k]].astype(np.int64)
        sets[k] = packed(*gaps(np.sort(own)))
    raw = digests.tobytes()
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=known == 0), pa.array(sizes, pa.int64()), pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary()), pa.array(sets, pa.binary()), pa.array(first, pa.list_(pa.int64()))], schema=_DOC)


def sized_shingles(text: str | None) -> tuple[int, bytes, np.ndarray]:
    s = shingles(text)
    return len(s), xxhash.xxh3_128_digest(s.tobytes()), s


def shared_shingles(df: DataFrame) -> DataFrame:
    """(doc_id, n, digest, tokens, first) of every row; the last two null where no other document can be linked."""
    return shared_tokens(df, sized_shingles, gathered, "doc_id long, n long, digest binary, tokens binary, first array<long>", once=True)


class CountTree:
    """R-tree over count vectors: boxes by repeated median cuts of the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 16):
        self.points, self.sizes = points, sizes
        self.root = self._box(np.arange(len(sizes)), leaf)

    def _box(self, at: np.ndarray, leaf: int):
        p = self.points[at]
        high = p.max(0)
        if len(at) <= leaf:
            return (high, int(self.sizes[at].min()), at, None)
        order = at[np.argsort(p[:, np.argmax(high - p.min(0))], kind="stable")]  # unsigned, but high is never below
        half = len(at) // 2
        return (high, int(self.sizes[at].min()), at, (self._box(order[:half], leaf), self._box(order[half:], leaf)))

    def pairs(self, other: CountTree, same: bool):
        """Index pairs whose summed minima allow 100 |A and B| >= 80 |A or B|."""
        todo = [(self.root, other.root)]
        while todo:
            u, v = todo.pop()
            if 9 * int(np.minimum(u[0], v[0]).sum(dtype=np.int64)) < 4 * (u[1] + v[1]):
                continue
            if u[3] is None and v[3] is None:
                i, j = u[2], v[2]
                both = np.minimum(self.points[i][:, None, :], other.points[j][None, :, :]).sum(2, dtype=np.int64)
                x, y = np.nonzero(9 * both >= 4 * (self.sizes[i][:, None] + other.sizes[j][None, :]))
                yield i[x], j[y]
            elif v[3] is None or u[3] is not None and len(u[2]) >= len(v[2]):
                # within one tree each unordered pair of boxes is taken once
                if same and u is v:
                    a, b = u[3]
                    todo += [(a, a), (a, b), (b, b)]
                else:
                    todo += [(c, v) for c in u[3]]
            else:
                todo += [(u, c) for c in v[3]]


def linked(a: np.ndarray, b: np.ndarray, m: int | None = None, n: int | None = None) -> bool:
    """Jaccard similarity of at least 0.8, in whole numbers, of sets of ``m`` and ``n`` members; of these
    ``a`` and ``b`` hold, sorted, at least those that another set has."""
    m, n = len(a) if m is None else m, len(b) if n is None else n
    if 5 * min(m, n) < 4 * max(m, n):
        return False
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 9 * both >= 4 * (m + n)


def block_edges(docs: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], mine: np.ndarray, p: int, q: int) -> list[tuple[int, int]]:
    """Links that connect all documents of block ``p`` and of block ``q`` that links between the two connect."""
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    i, j = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
    if not len(i) or not len(j):
        return []
    points = np.stack([counts(s) for s in sets])
    points = points.astype(np.uint16 if points.max() < 1 << 16 else np.uint32)
    one = CountTree(points[i], sizes[i])
    found = []
    for x, y in one.pairs(one if p == q else CountTree(points[j], sizes[j]), p == q):
        for a, b in zip(i[x].tolist(), j[y].tolist(), strict=True):
            if (u := root(a)) != (v := root(b)) and linked(sets[a], sets[b], int(sizes[a]), int(sizes[b])):
                parent[u] = v
                found.append((int(docs[a]), int(docs[b])))
    return found


def family_links(members: DataFrame, sets: DataFrame, chunk: int, room: int = 1 << 24) -> DataFrame:
    """Edges (a, b) of ``members(kind, family, doc)``, each pair of blocks of a family in turn.

    A block has about ``chunk`` documents, and ``room`` bytes of packed sets."""
    rows = members.join(sets, "doc")
    parts = rows.groupBy("kind", "family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum(F.length("tokens")) / room)).cast("int").alias("parts"))
    rows = rows.join(parts, ["kind", "family"]).withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("kind", "family", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "doc", "n", "tokens")

    def run(batches):
        def edges(held):
            found = block_edges(np.array([r[5] for r in held], np.int64), np.array([r[6] for r in held], np.int64), [joined_gaps(*unpacked(r[7])) for r in held], np.array([r[4] for r in held]), *at[2:])
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held, at = [], None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:4] != at and held:
                    yield edges(held)
                    held = []
                at = r[:4]
                held.append(r)
        if held:
            yield edges(held)

    return rows.repartition("kind", "family", "p", "q").sortWithinPartitions("kind", "family", "p", "q").mapInArrow(tidy(run), "a long, b long")


def similar_documents(df: DataFrame, scratch: Scratch | None = None, chunk: int = 1024, whole: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``df(doc_id, text)``.

    ``chunk``: documents of a block; ``whole``: blocks of a family beyond which it falls apart by first shingle."""
    scratch = scratch or Scratch(df.sparkSession)
    if df.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return joined(df, scratch, chunk, whole)
    # Saved, since numbers must not change between reads.
    rows = scratch.save(df.select("doc_id", "text").withColumn("number", F.expr("IF(doc_id IS NULL, NULL, monotonically_increasing_id())")), "rows")
    found = scratch.save(joined(rows.select(F.col("number").alias("doc_id"), "text"), scratch, chunk, whole), "found").withColumnRenamed("doc_id", "number")
    known = found.join(rows.select("number", "doc_id"), "number").select("doc_id", "n_shingles", F.col("component_id").alias("part"))
    low = known.groupBy("doc_id").agg(F.min("part").alias("low"))
    ties = components(known.join(low, "doc_id").select(F.col("low").alias("a"), F.col("part").alias("b")), scratch)
    known = known.join(ties, known.part == ties.id, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "part").alias("whole"))
    least = known.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    unknown = found.where("number IS NULL").select(F.col("number").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return known.join(least, "whole").select("doc_id", "n_shingles", "component_id").union(unknown)


def joined(df: DataFrame, scratch: Scratch, chunk: int, whole: int) -> DataFrame:
    """``similar_documents`` of rows of which none repeats a doc_id."""
    docs = scratch.save(shared_shingles(df), "docs")
    same = docs.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    base = scratch.save(docs.select("doc_id", "n", "digest").join(same, "digest", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "base")
    # Equal sets of different batches were all sent: one of them stands for the smallest doc_id.
    live = docs.where("tokens IS NOT NULL").dropDuplicates(["digest"]).join(same, "digest").select(F.col("rep").alias("doc"), "n", "tokens", "first")
    live = scratch.save(live, "sets")
    firsts = live.select("doc", F.explode("first").alias("key"))
    several = firsts.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    shared = scratch.save(firsts.join(several.select("key", "low"), "key"), "shared")
    families = scratch.save(components(shared.select(F.col("low").alias("a"), F.col("doc").alias("b")), scratch), "families")
    large = families.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk * whole).select(F.col("component_id").alias("id"))
    large = scratch.save(families.join(large, families.component_id == large.id, "left_semi").select(F.col("id").alias("doc")), "large")
    members = families.select(F.lit(0).alias("kind"), F.col("component_id").alias("family"), F.col("id").alias("doc"))
    if not large.isEmpty():
        apart = shared.join(large, "doc", "left_semi").select("key", "doc")
        # Keys with the same members say the same: one of them is enough.
        alike = apart.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("h"), F.bit_xor(F.xxhash64("doc", F.lit(7))).alias("k"))
        one = alike.groupBy("n", "h", "k").agg(F.min("key").alias("key")).select("key")
        members = members.join(large, "doc", "left_anti").select("kind", "family", "doc").union(apart.join(one, "key", "left_semi").select(F.lit(1), "key", "doc"))
    edges = scratch.save(family_links(members, live.select("doc", "n", "tokens"), chunk), "links")
    found = components(edges, scratch)
    return base.join(found, base.rep == found.id, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))
