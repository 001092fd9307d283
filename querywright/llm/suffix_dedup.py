"""Operator 8: removal of repeated passages by merged Burrows-Wheeler transforms.

A byte goes if a string of ``span`` (50) bytes that covers it also starts in a document with a smaller
doc_id.  Such strings are the intervals of depth 50 of a suffix array over all texts.

Sorting every suffix is not needed to find them, and is too dear (see README).  First an exact sieve:
in each window of 50 bytes the 16-gram with the smallest hash is its anchor; equal windows have equal
anchors, at the same place, so only windows whose anchor occurs in two documents can repeat.  Runs of
windows with one anchor are sent as their bytes, to where the anchor's others are.  There:

* equal runs are one string, held by the smallest doc_id among them; others lose all its windows;
* strings that share an anchor but differ are cut to the windows that others hold, and made one again
  where that makes them equal;
* those that still differ are sorted shard by shard (a shard is what one task sent),
  giving each shard's Burrows-Wheeler transform; the transforms are merged by iterative
  interleave refinement: a round orders suffixes by one more byte, and keeps where prefixes begin to
  differ, so after 50 rounds the blocks between are the repeated strings, whichever shards they are of.
  No suffix is sorted again.

Matches never cross documents.  Null texts are empty.  Rows that repeat a doc_id do not remove
each other's bytes; each loses what smaller doc_ids hold of its own text.  Rows with a null doc_id remove nothing and lose nothing.  Texts go whole through
every step.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batch_counts import batch_slices, gaps, joined_gaps, narrow, packed, planes, regrouped, shared_tokens, starts, unpacked
from .common import Scratch, distinct, documents, mixed, small_batches, tidy

SPAN, GRAM = 50, 16
#: Bytes of a text whose anchors are found at a time; places in it take 24 bits.
SLICE = 1 << 23
#: Bytes of strings that are settled together, but for those of one anchor.
TOGETHER = 1 << 19


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on."""
    a = x.astype(np.uint64)
    for k in (1, 2, 4):
        a = a[:-k] | (a[k:] << np.uint64(8 * k))
    return mixed(mixed(a[:-8]) ^ a[8:])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: (hash of the anchor, first window, last window)."""
    hashes, first, last = [], [], []
    low = np.uint64(SLICE * 2 - 1)
    for at in range(0, max(1, len(x) - SPAN + 1), SLICE):
        part = x[at : at + SLICE + SPAN - 1]
        if len(part) < SPAN:
            continue
        h = gram_hashes(part)
        m = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), SPAN - GRAM + 1)
        begin = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        hashes.append(h[(m[begin] & low).astype(np.int64)])
        first.append(begin + at)
        last.append(np.concatenate([begin[1:], [len(m)]]) - 1 + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(first), np.concatenate(last)


class Shard:
    """All suffixes of some strings in order, and the two bytes before each.

    Bytes count from 1 (UTF-8 has none above 0xFE), and each string ends in a mark of its own, smaller
    than any byte; marks keep the strings' order."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        ends = starts + lengths
        text = np.frombuffer(b"\0".join(strings) + b"\0" * 9, np.uint8).copy()
        n = int(lengths.sum()) + len(strings)
        text[:n] += 1
        text[ends] = 0
        end = np.repeat(ends, lengths + 1)
        # Ranks by the first eight bytes, then by doubling; what a mark ends is equal after it.
        key = np.zeros(n, np.uint64)
        place = np.arange(n)
        for k in range(8):
            key = (key << np.uint64(8)) | np.where(place + k < end, text[k : n + k], 0).astype(np.uint64)
        rank, done = self._ranks(key), 8
        while done <= int(lengths.max(initial=0)) and rank.max(initial=-1) < n - 1:
            later = place + done
            key = rank.astype(np.uint64) * np.uint64(n + 1) + np.where(later <= end, rank[np.minimum(later, n - 1)] + 1, 0).astype(np.uint64)
            rank = self._ranks(key)
            done *= 2
        order = np.argsort(rank, kind="stable")
        owner = np.repeat(np.arange(len(strings)), lengths + 1)
        self.n, self.strings, self.offset = len(strings), owner[order], order - starts[owner[order]]
        one, two = text[order - 1].astype(np.uint16), text[order - 2].astype(np.uint16)
        #: The suffix two bytes earlier begins with these; 0 where there is none.
        self.before = np.where(self.offset >= 2, two << np.uint16(8) | one, 0).astype(np.uint16)
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.back = np.where(self.offset >= 2, row[np.maximum(order - 2, 0)], 0)
        #: Rows of the suffixes of no and of one byte, by string.
        self.marks, self.last, self.last_byte = row[ends], row[ends - 1], text[ends - 1].astype(np.uint16) << np.uint16(8)

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        return rank


def merge(shards: list[Shard], depth: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes in order of ``depth`` bytes: (shard, row in the shard, block of equal prefixes).

    The interleave says which row of which shard each place of the merged order has.  A round carries
    it two bytes further: the places, taken in order and dealt by the two bytes before them, are the
    new order of the suffixes two bytes longer.  Neighbours share h + 2 bytes if they have the same
    two and share h.  No suffix is sorted again."""
    if not shards:
        return (np.zeros(0, np.int64),) * 3
    sizes = [len(s.before) for s in shards]
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    before = np.concatenate([s.before for s in shards])
    back = np.concatenate([s.back + b for s, b in zip(shards, base, strict=True)])
    marks, last = (np.concatenate([getattr(s, k) + b for s, b in zip(shards, base, strict=True)]) for k in ("marks", "last"))
    last_byte = np.concatenate([s.last_byte for s in shards])
    m = len(marks)
    at = np.concatenate([marks, np.setdiff1d(np.arange(len(before)), marks)])
    block = np.zeros(len(at), np.int64)  # no byte read yet: all alike
    for _ in range(-(-depth // 2)):
        two = before[at]
        on = np.flatnonzero(two)
        # Suffixes of one byte have no row two bytes on: each is a block of its own.
        key = np.concatenate([last_byte, two[on]])
        order = np.argsort(key, kind="stable")
        rows = np.concatenate([last, back[at[on]]])[order]
        old = np.concatenate([-1 - np.arange(m), block[on]])[order]
        key = key[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])])
        at = np.concatenate([marks, rows])
        block = np.concatenate([np.arange(m), m - 1 + np.cumsum(new)])
    shard = np.searchsorted(base, at, side="right") - 1
    return shard, at - base[shard], block


def repeated(strings: list[bytes], holders: np.ndarray, shard_of: np.ndarray, depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) of every ``depth`` (an even number of) bytes that also stand in a string of a smaller holder."""
    members = [np.flatnonzero(shard_of == k) for k in np.unique(shard_of)]
    shards = [Shard([strings[i] for i in m]) for m in members]
    z, row, block = merge(shards, depth)
    if not len(z):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string = np.empty(len(z), np.int64)
    place = np.empty(len(z), np.int64)
    for k, (s, m) in enumerate(zip(shards, members, strict=True)):
        at = z == k
        string[at], place[at] = m[s.strings[row[at]]], s.offset[row[at]]
    holder = holders[string]
    begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.repeat(np.minimum.reduceat(holder, begin), np.diff(np.concatenate([begin, [len(z)]])))
    lengths = np.array([len(s) for s in strings])[string]
    hit = (holder > least) & (place + depth <= lengths)
    return string[hit], place[hit]


def shared_windows(strings: list[bytes], holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each string that another holder has too, by hash; (0, -1) where none."""
    lengths = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    x = np.frombuffer(b"".join(strings), np.uint8)
    a = x.astype(np.uint64)
    for k in (1, 2, 4):
        a = a[:-k] | (a[k:] << np.uint64(8 * k))
    n = len(x) - SPAN + 1
    h = np.zeros(n, np.uint64)
    for o in (*range(0, SPAN - 8, 8), SPAN - 8):
        h = mixed(h ^ a[o : o + n])
    owner = np.repeat(np.arange(len(strings)), lengths - SPAN + 1)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths - SPAN + 1) - (lengths - SPAN + 1), lengths - SPAN + 1)
    h = h[starts[owner] + place]
    order = np.argsort(h)
    who = holders[owner[order]]
    begin = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    several = np.repeat(np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin), np.diff(np.concatenate([begin, [len(h)]])))
    hit = order[several]
    first, last = np.full(len(strings), SPAN * 100), np.full(len(strings), -1)
    np.minimum.at(first, owner[hit], place[hit])
    np.maximum.at(last, owner[hit], place[hit])
    return np.where(last < 0, 0, first), last


def text_anchors(text: str | None) -> tuple[int, bytes, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), b"", distinct(anchors(np.frombuffer(raw, np.uint8))[0] >> np.uint64(8))


def own_anchors(head: list[np.ndarray], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    docs = head[0]
    t, n = regrouped(head, parts)
    ends = np.cumsum(n)
    has = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(docs[has]), pa.array([packed(*gaps(np.sort(t[e - k : e]))) for e, k in zip(ends[has].tolist(), n[has].tolist(), strict=True)], pa.binary())], ["doc_id", "anchors"])


def shared_anchors(df: DataFrame) -> DataFrame:
    """(doc_id, anchors): the anchors of each document that other rows have too."""
    return shared_tokens(df, text_anchors, own_anchors, "doc_id long, anchors binary")


def squeezed(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, z, carried columns): texts compressed, as they are to be shuffled."""
    small_batches(df.sparkSession)

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.binary()), *b.columns[2:]], ["doc_id", "z", *carry])

    return df.select("doc_id", "text", *carry).mapInArrow(run, "doc_id long, z binary" + typed(df, carry))


def typed(df: DataFrame, names: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f", `{c}` {kinds[c]}" for c in names)


def text_key(raw: bytes) -> int:
    """Tells texts of one doc_id apart; never 0."""
    return xxhash.xxh3_64_intdigest(raw) >> 1 or 1


def removals(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, runs): first and last window, as packed 4-byte numbers, of runs of windows to remove.

    The key is 0 where a doc_id has one row only."""
    shared = shared_anchors(df).groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors"))
    repeats = df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id", F.lit(True).alias("several"))
    shared = shared.join(repeats, "doc_id", "left")
    slices = np.uint64(batch_slices(df.sparkSession))
    groups = batch_slices(df.sparkSession) // 16

    def send(batches):
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress

        def flush(held):
            t, docs, keys, first = (np.concatenate([h[k] for h in held]) for k in range(4))
            bodies = [x for h in held for x in h[4]]
            # Equal runs of one anchor are sent once.
            digest = np.fromiter(map(xxhash.xxh3_64_intdigest, bodies), np.uint64, len(bodies))
            by = np.lexsort((digest, np.fromiter(map(len, bodies), np.int64, len(bodies)), t))
            t, docs, keys, first, digest = t[by], docs[by], keys[by], first[by], digest[by]
            bodies = [bodies[i] for i in by.tolist()]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (digest[1:] != digest[:-1])])
            for i in np.flatnonzero(~new).tolist():
                new[i] = bodies[i] != bodies[i - 1]
            at = np.flatnonzero(new)
            anchor, many, bodies = t[at], np.diff(np.append(at, len(t))), [bodies[i] for i in at.tolist()]
            ends = np.append(at, len(t))
            piece = ((anchor >> np.uint64(24)) * slices >> np.uint64(32)).astype(np.int64)
            cuts = np.append(starts(piece), len(piece)).tolist()
            low, rows = int(docs.min()), []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part, at = bodies[a:b], slice(ends[a], ends[b])
                meta = packed(*gaps(anchor[a:b]), narrow(np.array(list(map(len, part)))), narrow(many[a:b]), *planes(docs[at] - low), keys[at], *planes(first[at]))
                rows.append((int(piece[a]), meta, pack(b"".join(part))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([low] * len(rows), pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], ["slice", "low", "meta", "bodies"])

        held, n = [], 0
        for b in batches:
            for d, z, lists, several in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = unpack(z.as_buffer())
                h, first, last = anchors(np.frombuffer(raw, np.uint8))
                t = h >> np.uint64(8)
                hit = np.isin(t, np.concatenate([joined_gaps(*unpacked(x)) for x in lists]))
                if hit.any():
                    t, first, last = t[hit], first[hit], last[hit]
                    bodies = [raw[a : e + SPAN] for a, e in zip(first.tolist(), last.tolist(), strict=True)]
                    held.append((t, np.full(len(t), d, np.int64), np.full(len(t), text_key(raw) if several else 0, np.int64), first, bodies))
                    n += len(t)
                if n >= 500_000:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def meet(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        done: list[tuple] = []

        def settle(rows):
            ts, docs, keys, firsts, shard, kinds, bodies = [], [], [], [], [], [], []
            for low, meta, body in rows:
                t_low, t_high, sizes, many, d_low, d_high, key, f_low, f_high = unpacked(meta)
                body, many = unpack(body), many.astype(np.int64)
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                kinds.append(np.repeat(np.arange(len(sizes)) + len(bodies), many))
                bodies += [body[a:e] for a, e in zip([0, *ends], ends, strict=False)]
                ts.append(np.repeat(joined_gaps(t_low, t_high), many))
                docs.append((d_low.astype(np.int64) | d_high.astype(np.int64) << 8) + low)
                keys.append(key)
                firsts.append(f_low.astype(np.int64) | f_high.astype(np.int64) << 8)
                shard.append(np.full(len(key), len(shard)))
            t, *rest = (np.concatenate(x) for x in (ts, docs, keys, firsts, shard, kinds))
            order = np.argsort(t, kind="stable")
            t, rest = t[order], [x[order] for x in rest]
            # Strings of different anchors share no window: some anchors at a time.
            at = starts(t)
            size = np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies))[rest[-1]])[np.append(at[1:], len(t)) - 1]
            cuts = np.append(at[starts(size // TOGETHER)], len(t)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                kinds, inverse = np.unique(rest[-1][a:b], return_inverse=True)
                done.append(resolve(t[a:b], *(x[a:b] for x in rest[:-1]), inverse, [bodies[i] for i in kinds.tolist()]))

        rows, now = [], None
        for b in batches:
            for piece, low, meta, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if piece != now and rows:
                    settle(rows)
                    rows = []
                    if sum(len(x[0]) for x in done) >= 500_000:
                        yield dealt(done, groups)
                        done.clear()
                now = piece
                rows.append((low, meta, body))
        if rows:
            settle(rows)
        if done:
            yield dealt(done, groups)

    texts = squeezed(df.where("doc_id is not null")).join(shared, "doc_id")
    sent = texts.mapInArrow(tidy(send), "slice int, low long, meta binary, bodies binary")
    runs = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(tidy(meet), "part int, body binary")
    return scratch.save(runs.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(by_document), "doc_id long, text_key long, runs binary"), "runs")


def dealt(found: list[tuple], groups: int) -> pa.RecordBatch:
    """Rows (part, body) of removed windows (documents, keys, first, last), packed by groups of documents."""
    d, key, a, b = (np.concatenate([f[k] for f in found]) for k in range(4))
    group = (mixed(d.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((a, key, d, group))
    d, key, a, b, group = d[order], key[order], a[order], b[order], group[order]
    cuts = np.append(starts(group), len(group)).tolist()
    rows = [(int(group[x]), packed(d[x:y], key[x:y], a[x:y].astype("<u4"), narrow(b[x:y] - a[x:y]))) for x, y in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "body"])


def by_document(batches):
    """Batches (doc_id, text_key, runs): a row for each text of which windows go."""
    held, now = [], None
    for batch in batches:
        for part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != now and held:
                yield from grouped(held)
                held = []
            now = part
            held.append(unpacked(body))
    if held:
        yield from grouped(held)


def grouped(found: list[list[np.ndarray]]):
    d, key, a, b = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(4))
    b = a + b
    order = np.lexsort((key, d))
    d, key = d[order], key[order]
    runs = np.stack([a[order], b[order]], 1).astype("<u4")
    cuts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (key[1:] != key[:-1])])) if len(d) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(d))
    for i in range(0, len(cuts), 10_000):
        part = slice(i, i + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(d[cuts[part]]), pa.array(key[cuts[part]]), pa.array([runs[x:y].tobytes() for x, y in zip(cuts[part].tolist(), ends[part].tolist(), strict=True)], pa.binary())], ["doc_id", "text_key", "runs"])


def resolve(t, docs, keys, first, shard, kinds, bodies) -> tuple[np.ndarray, ...]:
    """(documents, keys, first, last) of windows that stand in smaller documents, among runs of known anchors."""
    # Equal runs are one string, held by its smallest document.
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(b, len(number)) for b in bodies), np.int64, len(bodies))[kinds]
    strings = list(number)
    holder = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(holder, kind, docs)
    lengths = np.array([len(s) for s in strings], np.int64)
    out_doc, out_key, out_a, out_b = [], [], [], []
    lost = docs > holder[kind]
    out_doc.append(docs[lost])
    out_key.append(keys[lost])
    out_a.append(first[lost])
    out_b.append(first[lost] + lengths[kind[lost]] - SPAN)
    # Strings that share an anchor with others are cut to the windows that other holders have.
    one = np.full(len(strings), -1)
    one[kind[::-1]] = np.arange(len(kind))[::-1]
    _, inverse, many = np.unique(t[one], return_inverse=True, return_counts=True)
    some = np.flatnonzero(many[inverse] > 1)
    hit_string, hit_first, hit_last = [], [], []
    if len(some):
        lo, hi = shared_windows([strings[i] for i in some], holder[some])
        some, lo, hi = some[hi >= 0], lo[hi >= 0], hi[hi >= 0]
        # What is equal now is one string again, held by the smallest document.
        number = {}
        cut = np.fromiter((number.setdefault(strings[i][a : e + SPAN], len(number)) for i, a, e in zip(some.tolist(), lo.tolist(), hi.tolist(), strict=True)), np.int64, len(some))
        parts = list(number)
        keeper = np.full(len(parts), np.iinfo(np.int64).max)
        np.minimum.at(keeper, cut, holder[some])
        gone = holder[some] > keeper[cut]
        hit_string.append(some[gone])
        hit_first.append(lo[gone])
        hit_last.append(hi[gone])
        # The rest share windows but neither begin nor end alike.
        if parts:
            left = np.flatnonzero(shared_windows(parts, keeper)[1] >= 0)
            some, lo, cut = some[~gone], lo[~gone], cut[~gone]
            if len(left):
                source = np.zeros(len(parts), np.int64)
                source[cut] = shard[one[some]]
                p, place = repeated([parts[i] for i in left], keeper[left], source[left])
                p = left[p]
                # Every string cut to this part loses the windows.
                order = np.argsort(cut, kind="stable")
                a, b = np.searchsorted(cut[order], p), np.searchsorted(cut[order], p, side="right")
                rep = np.repeat(np.arange(len(p)), b - a)
                at = order[np.repeat(a, b - a) + np.arange(len(rep)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
                hit_string.append(some[at])
                hit_first.append(lo[at] + place[rep])
                hit_last.append(lo[at] + place[rep])
    if hit_string:
        s, lo, hi = (np.concatenate(x) for x in (hit_string, hit_first, hit_last))
        # The holder of a string loses these windows wherever it has the string.
        own = np.flatnonzero(~lost)
        own = own[np.argsort(kind[own], kind="stable")]
        a, b = np.searchsorted(kind[own], s), np.searchsorted(kind[own], s, side="right")
        rep = np.repeat(np.arange(len(s)), b - a)
        at = own[np.repeat(a, b - a) + np.arange(len(rep)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
        out_doc.append(docs[at])
        out_key.append(keys[at])
        out_a.append(first[at] + lo[rep])
        out_b.append(first[at] + hi[rep])
    return tuple(np.concatenate(x) for x in (out_doc, out_key, out_a, out_b))


def kept_bytes(raw: bytes, lists: list[bytes] | None) -> tuple[bytes, int, int]:
    """What is left of a text, and how many bytes went in how many spans."""
    if not lists:
        return raw, 0, 0
    runs = np.frombuffer(b"".join(lists), "<u4").reshape(-1, 2).astype(np.int64)
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 1] + SPAN, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())


def own_runs(raw: bytes, keys: list[int] | None, lists: list[bytes] | None) -> list[bytes] | None:
    """Of the runs of a doc_id, those of this text."""
    if not keys or not any(keys):
        return lists
    own = text_key(raw)
    return [x for k, x in zip(keys, lists, strict=True) if k == own]


def remove_repeats(df: DataFrame, scratch: Scratch | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, carried columns): ``kept`` is what remains, as bytes.

    ``carry``: columns of ``df`` that each row keeps; others are not read."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    runs = removals(df, scratch).groupBy("doc_id").agg(F.collect_list("text_key").alias("keys"), F.collect_list("runs").alias("runs"))

    def apply(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            raw = [unpack(z.as_buffer()) for z in b.column(1)]
            done = [kept_bytes(r, own_runs(r, k, x)) for r, k, x in zip(raw, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array([x[0] for x in done], pa.binary()), *b.columns[4:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry])

    runs = runs.withColumnRenamed("doc_id", "_run")
    rows = squeezed(df, carry).join(runs, F.col("doc_id") == F.col("_run"), "left").select("doc_id", "z", "keys", "runs", *carry)
    return rows.mapInArrow(tidy(apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + typed(df, carry))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
