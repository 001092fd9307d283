"""Operator 3: fingerprints by randomised edit embedding.

A shared random walk reads the characters of a text: at time t, on character c, a coin that all
texts share for (t mod period, class of c) says whether to stay or to go on.  Texts that are equal but
for a few edits fall into step again after each edit, so edit distance becomes Hamming distance along
the walk.  The fingerprint samples the walk at fixed random times: a byte for the eight
characters ahead of where it stands, 0 after its end.  Times cover the walk of texts up to 2**s
characters; a fingerprint holds the scale s that fits the text, and s + 1, so that texts of up to
twice the length compare on one scale.

Likeness: equal samples among those where either walk is still under way, on the scale of the longer
text; 0 if the scales differ by more than one; 1 for equal texts and for two empty ones.

Null texts are empty.  Equal doc_ids are ordered by text.  A table of one row is its own successor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, mixed, small_batches

PERIOD, SAMPLES, AHEAD = 4096, 96, 8
#: Characters of a sample in a band of ``near_texts``; groups of its count vectors.
NEAR, GROUPS = 6, 256
#: Characters that walk together; bounds a worker's memory.
TOGETHER = 6_000_000


def _stays() -> np.ndarray:
    """For class and time: steps until the walk goes on."""
    coin = (mixed(np.arange(256 * PERIOD)) & np.uint64(1)).astype(bool).reshape(256, PERIOD)
    coin[:, -1] = True
    out = np.zeros((256, PERIOD), np.uint32)
    left = np.ones(256, np.uint32)
    for t in range(PERIOD - 1, -1, -1):
        left = np.where(coin[:, t], 1, left + 1).astype(np.uint32)
        out[:, t] = left
    return out.ravel()


def scale_of(n: int) -> int:
    return max(0, n - 1).bit_length()


_STAYS: list[np.ndarray] = []
_TIMES: dict[int, np.ndarray] = {}


def times(s: int) -> np.ndarray:
    if s not in _TIMES:
        _TIMES[s] = np.sort(mixed(np.arange(SAMPLES) + 1000 * (s + 1)) % np.uint64(2 * 2**s + 8)).astype(np.int64)
    return _TIMES[s]


def walk(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time at which each walk comes to each of its characters, and at which it ends."""
    if not _STAYS:
        _STAYS.append(_stays())
    stays = _STAYS[0]
    cls = ((flat * np.uint32(2654435761)) >> np.uint32(24)) * np.uint32(PERIOD)
    order = np.argsort(-lengths, kind="stable")
    at, n = offsets[order].copy(), lengths[order]
    t = np.zeros(len(order), np.uint32)
    out = np.zeros(len(flat), np.uint32)
    ends = np.zeros(len(order), np.uint32)
    # Lanes are sorted by length, so those still under way are the first ones.
    left = np.searchsorted(-n, -np.arange(0, int(n.max(initial=0)) + 1), side="left")
    mask = np.uint32(PERIOD - 1)
    for i in range(int(n.max(initial=0))):
        a = left[i]
        here, now = at[:a], t[:a]
        out[here] = now
        now += stays.take(cls.take(here) | (now & mask))
        here += 1
    ends[order] = t
    return out, ends


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts."""
    done: list[str] = []
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= TOGETHER):
            held += len(texts[stop])
            stop += 1
        done += _some(texts[at:stop])
        at = stop
    return done


def _spots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All characters, where each sample stands in them (-1 after the walk's end), where each text ends, and scales."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    came, ends = walk(flat, offsets, lengths)
    scales = [scale_of(int(n)) for n in lengths]
    spots = np.full((len(texts), 2 * SAMPLES), -1, np.int64)
    for k, (o, n, e, s) in enumerate(zip(offsets, lengths, ends, scales, strict=True)):
        when = np.concatenate([times(s), times(s + 1)])
        spots[k] = np.where(when < e, o + np.searchsorted(came[o : o + n], when, side="right") - 1, -1)
    return flat, spots, offsets + lengths, scales


def _ahead(flat: np.ndarray, spots: np.ndarray, last: np.ndarray, ahead: int) -> np.ndarray:
    """Hash of the characters ahead of each spot, up to the end of its text."""
    h = np.zeros(spots.shape, np.uint64)
    for j in range(ahead):
        where = spots + j
        ok = (spots >= 0) & (where < last[:, None])
        h = mixed(h ^ np.where(ok, flat[np.where(ok, where, 0)] + np.uint32(1), 0).astype(np.uint64)) if len(flat) else h
    return h


def _some(texts: list[str]) -> list[str]:
    flat, spots, last, scales = _spots(texts)
    sample = np.where(spots >= 0, _ahead(flat, spots, last, AHEAD) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)
    return [f"{s:02x}{row.tobytes().hex()}" for s, row in zip(scales, sample, strict=True)]


def bands(texts: list[str], width: int) -> list[np.ndarray]:
    """Band keys of each text: ``width`` adjacent samples of a scale, each of NEAR characters, all under way."""
    flat, spots, last, scales = _spots(texts)
    n = SAMPLES // width
    cut = lambda x: x.reshape(len(texts), 2, SAMPLES)[:, :, : n * width].reshape(len(texts), 2, n, width)
    h, ok = cut(_ahead(flat, spots, last, NEAR)), cut(spots >= 0).all(3)
    key = np.zeros(ok.shape, np.uint64)
    for k in range(width):
        key = mixed(key ^ h[..., k])
    at = np.arange(n) + 1000 * (np.array(scales, np.int64).reshape(-1, 1, 1) + np.arange(2)[:, None])
    key = mixed(key ^ mixed(at)).view(np.int64)
    return [np.unique(k[o]) for k, o in zip(key, ok, strict=True)]


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    sa, sb = int(a[:2], 16), int(b[:2], 16)
    if abs(sa - sb) > 1:
        return 0.0
    s = max(sa, sb)
    x, y = (np.frombuffer(bytes.fromhex(f[2:]), np.uint8)[(s - own) * SAMPLES :][:SAMPLES] for f, own in ((a, sa), (b, sb)))
    either = (x > 0) | (y > 0)
    return float((x == y)[either].mean()) if either.any() else 1.0


def edited(text: str, after: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KIND = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edge", pa.int32()), ("part", pa.int32()), ("body", pa.binary())])


def compare_neighbours(docs: list, texts: list[str], prints: list[str]) -> list[list]:
    """Columns of all but the last document, each against the one after it."""
    changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    own = fingerprints(changed)
    return [
        docs[:-1],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        prints[:-1],
        own,
        [likeness(a, b) for a, b in zip(prints, own, strict=False)],
        [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)],
    ]


def neighbour_fingerprints(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Each document against its edited text and the next document by descending doc_id.

    Texts are shuffled once, compressed, into ranges of doc_id; neighbours meet inside their range,
    and only the two outermost documents of each range are joined again."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    small_batches(spark)

    def squeeze(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "z"])

    def inside(batches):
        import zstandard
        from pyspark import TaskContext

        unpack = zstandard.ZstdDecompressor().decompress
        part = TaskContext.get().partitionId()
        docs: list = []
        texts: list[str] = []
        prints: list[str] = []

        def edge(k, which):
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([docs[k], len(texts[k]), None, prints[k], None, None, None, which, part, texts[k].encode()], _KIND, strict=True)], schema=_KIND)

        for b in batches:
            bodies = b.column(1)
            for i in range(0, len(bodies), 4000):
                new = [unpack(x.as_buffer()).decode() for x in bodies.slice(i, 4000)]
                fresh = not docs
                docs, texts, prints = docs[-1:] + b.column(0).slice(i, 4000).to_pylist(), texts[-1:] + new, prints[-1:] + fingerprints(new)
                if fresh:
                    yield edge(0, 0)
                cols = compare_neighbours(docs, texts, prints)
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, [-1] * n, [part] * n, [None] * n], _KIND, strict=True)], schema=_KIND)
        if docs:
            yield edge(-1, 1)

    def between(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                cols = compare_neighbours([r["doc_id"], None], [r["body"].decode(), r["next_body"].decode()], [r["fingerprint"], r["next_fingerprint"]])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, list(_KIND)[:7], strict=True)], schema=pa.schema(list(_KIND)[:7]))

    sent = df.select("doc_id", "text").mapInArrow(squeeze, "doc_id long, z binary")
    dealt = sent.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "z")
    saved = scratch.save(dealt.mapInArrow(inside, _ROW + ", edge int, part int, body binary"), "neighbours")
    # A row per range: the next range that holds rows, the last one's being the first.
    parts = saved.where("edge = 0").select("part")
    w = Window.partitionBy(F.lit(0))
    order = w.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(w)).alias("next_part"))
    first = saved.where("edge = 0").select(F.col("part").alias("next_part"), F.col("fingerprint").alias("next_fingerprint"), F.col("body").alias("next_body"))
    ends = saved.where("edge = 1").join(after, "part").join(first, "next_part").select("doc_id", "fingerprint", "body", "next_fingerprint", "next_body")
    names = [f.name for f in list(_KIND)[:7]]
    return saved.where("edge = -1").select(*names).union(ends.mapInArrow(between, _ROW))


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance, a column of the table at a time in one integer's bits; above ``most`` only that it is above."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = rows.get(c, 0)
        diag = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(diag | up) & full, up & diag
        d += 1 if rise & top else -1 if fall & top else 0
        if most is not None and d - left > most:
            return most + 1
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up, down = fall | ~(diag | rise) & full, rise & diag
    return d


def similarity(a: str, b: str, least: float) -> float | None:
    """1 - distance / longer length if that is ``least`` or more."""
    n = max(1, len(a), len(b))
    s = 1 - distance(a, b, int((1 - least) * n) + 1) / n
    return s if s >= least else None


def gram_counts(text: str) -> np.ndarray:
    """Counts of the characters, then of the pairs of adjacent characters, by hash group."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    both = [mixed(x), mixed(mixed(x[:-1]) ^ x[1:])]
    return np.concatenate([np.bincount((h % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS) for h in both]).astype(np.int32)


def near_in_blocks(one: list[str], two: list[str] | None, least: float):
    """(i, j, similarity) of all near texts of two blocks, or within one.

    d edits spoil at most d characters and 2 d pairs of characters, so sums of minima bound them from below."""
    other = one if two is None else two
    v, w = (np.array([gram_counts(t) for t in x]).reshape(-1, 2 * GROUPS) for x in (one, other))
    sizes = np.array([len(t) for t in other], np.int64)
    for i, t in enumerate(one):
        first = i + 1 if two is None else 0
        n = np.maximum(sizes[first:], len(t))
        most = ((1 - least) * n).astype(np.int64) + 1
        low = np.minimum(v[i], w[first:])
        ok = (n - np.minimum(sizes[first:], len(t)) <= most) & (low[:, :GROUPS].sum(1) >= n - most) & (low[:, GROUPS:].sum(1) >= n - 1 - 2 * most)
        for j in np.flatnonzero(ok) + first:
            if (s := similarity(t, other[j], least)) is not None:
                yield i, int(j), s


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _near_batch(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(min(a, b), max(a, b), s) for a, b, s in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PAIR)], schema=_PAIR)


def all_near(texts: DataFrame, least: float, chunk: int) -> DataFrame:
    """Near pairs of ``texts(doc_id, text, key)``, each text held against all whose length allows it.

    Lengths fall into classes of powers of two, classes into blocks of about ``chunk`` texts; each task
    has two blocks."""
    reach = 0
    while 0 < least and least * 2**reach < 1:
        reach += 1
    size = F.length(F.bin(F.length("text"))) if least > 0 else F.lit(0)
    sized = texts.withColumn("size", size)
    parts = sized.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    dealt = sized.join(parts, "size").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    every = parts.select("size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    x, y = every.select(F.col("size").alias("s"), F.col("block").alias("p")), every.select(F.col("size").alias("t"), F.col("block").alias("q"))
    meet = x.join(y, (F.col("t") >= F.col("s")) & (F.col("t") <= F.col("s") + reach) & ((F.col("t") > F.col("s")) | (F.col("q") >= F.col("p"))))
    where = [F.col(c) for c in ("s", "p", "t", "q")]
    first = dealt.join(meet, (F.col("size") == F.col("s")) & (F.col("block") == F.col("p"))).select(*where, F.lit(0).alias("side"), "doc_id", "text")
    second = dealt.join(meet.where("s <> t OR p <> q"), (F.col("size") == F.col("t")) & (F.col("block") == F.col("q"))).select(*where, F.lit(1).alias("side"), "doc_id", "text")

    def hold(table: pa.Table) -> pa.Table:
        side, docs, bodies = (table.column(c).to_pylist() for c in ("side", "doc_id", "text"))
        i, j = ([k for k, x in enumerate(side) if x == want] for want in (0, 1))
        same = table.column("s")[0] == table.column("t")[0] and table.column("p")[0] == table.column("q")[0]
        found = near_in_blocks([bodies[k] for k in i], None if same else [bodies[k] for k in j], least)
        j = i if same else j
        return pa.Table.from_batches([_near_batch([(docs[i[a]], docs[j[b]], s) for a, b, s in found])])

    return first.union(second).groupBy("s", "p", "t", "q").applyInArrow(hold, "a long, b long, similarity double")


def banded_near(texts: DataFrame, least: float, width: int, chunk: int) -> DataFrame:
    """Near pairs of ``texts(doc_id, text, key)`` among all texts that share a band.

    A band of more than ``chunk`` texts is dealt in parts, each held against the whole band."""

    def mark(batches):
        for b in batches:
            found = bands(b.column(1).to_pylist(), width)
            keys = pa.array([k for k, f in zip(b.column(0).to_pylist(), found, strict=True) for _ in range(len(f))], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(found) if found else [], pa.int64())], ["key", "band"])

    def verify(batches):
        for b in batches:
            rows = ((r["a"], r["b"], similarity(r["ta"], r["tb"], least)) for r in b.to_pylist())
            yield _near_batch([r for r in rows if r[2] is not None])

    marked = texts.select("key", "text").mapInArrow(mark, "key binary, band long")
    parts = marked.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    shared = marked.join(parts, "band")
    left = shared.select("band", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.col("key").alias("other"))
    right = shared.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key")
    near = left.join(right, ["band", "part"]).where("other < key").select("key", "other").distinct()
    pairs = near.join(texts.select("key", F.col("doc_id").alias("b"), F.col("text").alias("tb")), "key")
    pairs = pairs.join(texts.select(F.col("key").alias("other"), F.col("doc_id").alias("a"), F.col("text").alias("ta")), "other")
    return pairs.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, similarity double")


def same_texts(df: DataFrame) -> DataFrame:
    """(doc_id, first) of each row with a doc_id: the smallest doc_id with the same text."""
    rows = df.where("doc_id IS NOT NULL").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return rows.join(rows.groupBy("key").agg(F.min("doc_id").alias("first")), "key").select("doc_id", "first")


def near_texts(df: DataFrame, least: float = 0.8, width: int = 1, exact: bool = True, chunk: int = 256) -> DataFrame:
    """Pairs (a, b, similarity) of doc_ids of different texts, 1 - distance / longer length >= least.

    All such pairs: each text is held against all whose length allows it, and what counts of characters
    and of their pairs do not rule out is verified by edit distance on the whole texts.  The
    work grows with the square of the texts of like length.

    With ``exact`` false only texts that share a band are verified: ``width`` adjacent samples of the
    walk, NEAR characters each (bit-sampled banding).  Pairs are lost where the walks do not fall into
    step again; README gives the measured recall.

    Equal texts stand for the smallest doc_id among them (see ``same_texts`` for membership).  Null texts
    are empty; rows with a null doc_id are left out.  Where one doc_id has two near texts, a = b."""
    small_batches(df.sparkSession)
    texts = df.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("key"))
    return all_near(texts, least, chunk) if exact else banded_near(texts, least, width, chunk)


def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(documents(spark, sf_dir))
