"""Sharding, packing, token files and mixing against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querywright.llm import mixing, packing, sharding, token_files, tokens


def tok(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path(name))


def curve(point, bits):
    """Skilling's transform, written plainly."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    h = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            h = h * 2 + ((v ^ t) >> b & 1)
    return h


def test_curve_visits_neighbours(spark):
    points = [(a, b, c) for a in range(8) for b in range(8) for c in range(8)]
    df = spark.createDataFrame([(list(p),) for p in points], "q array<long>")
    got = {tuple(r["q"]): r["h"] for r in df.withColumn("h", sharding.hilbert_index("q", 3, 3)).collect()}
    assert got == {p: curve(p, 3) for p in points}
    path = [p for p, _ in sorted(got.items(), key=lambda x: x[1])]
    assert sorted(got.values()) == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(path, path[1:], strict=False))


def test_shards(spark, data, docs):
    got = sharding.op1_hilbert_shards(spark, data).toPandas()
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(want)
    for r in got.itertuples():
        raw = (want[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    counts = got["shard"].value_counts()
    assert len(counts) == 16 and counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    again = sharding.op1_hilbert_shards(spark, data).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    order = got.sort_values(["shard", "slot"])["hilbert"].tolist()
    assert order == sorted(order)


def test_shards_prune(spark, data, docs):
    got = sharding.hilbert_shards(docs.select("doc_id", "lang", "n_chars"), ["lang", "n_chars"], ["doc_id"], 8)
    tight = sharding.manifest(got, ["lang", "n_chars"]).where("min_lang <= 'de' AND max_lang >= 'de'").count()
    assert 0 < tight < 8


@pytest.mark.parametrize("n", [0, 1, 5, 16, 33])
def test_few_rows(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"))
    got = sharding.hilbert_shards(df, ["source", "doc_id"], ["doc_id"]).toPandas()
    counts = [int((got["shard"] == k).sum()) for k in range(16)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1


def test_shards_awkward(awkward):
    got = sharding.hilbert_shards(awkward.drop("rank", "_p"), ["source", "lang", "n_chars", "doc_id"], ["doc_id", "text"]).toPandas()
    assert len(got) == 11 and got.groupby("shard").size().max() == 1


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunks_give_the_tokenizers_ids(name, drops, docs):
    from .conftest import AWKWARD

    texts = [r[1] or "" for r in AWKWARD] + [r["text"] for r in docs.limit(60).collect()]
    texts += ["a  b", " a", "a ", "a \n b", "a b c", "a \x1c b", "x <|endoftext|> y", "don 't 're  'll", "\x0b\x0cq r", "e ́x", " wide  　space"]
    t = tok(name)
    for text, ids in zip(texts, tokens.ChunkEncoder(tokens.public_path(name), drops).encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


def test_encoder_forgets():
    e = tokens.ChunkEncoder(tokens.public_path("byte_bpe_50k.json"), False, most=3)
    a = [x.tolist() for x in e.encode(["a b c", "d e f g"])]
    b = [x.tolist() for x in e.encode(["d e f g"])] + [x.tolist() for x in e.encode(["a b c"])]
    assert a == b[::-1]


def check_packing(got, want, capacity):
    spans = defaultdict(list)
    for r in got.itertuples():
        assert 1 <= r.length <= capacity
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    seen = Counter()
    for doc, g in got.groupby("doc_id", dropna=False):
        g = g.sort_values(["piece", "start"])
        seen[doc] = g
    for doc, ids in want.items():
        g = seen[doc]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        assert g["start"].tolist() == cuts[:-1] and g["length"].tolist() == np.diff(cuts).tolist()
        assert g["ids_crc32"].tolist() == [zlib.crc32(np.array(ids[a:b], "<u4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
    return len(spans)


def test_packing(spark, data, docs):
    t = tok("byte_bpe_50k.json")
    want = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    bins = check_packing(packing.op2_packing(spark, data).toPandas(), want, 1024)
    assert bins <= -(-sum(map(len, want.values())) // 1024) + 1


def test_packing_awkward(awkward, none):
    got = packing.pack_documents(awkward).toPandas()
    assert got["doc_id"].isna().sum() == 1 and (got["doc_id"] == 2).sum() == 2 and (got["doc_id"] == 8).sum() > 10
    assert packing.pack_documents(none).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    packed = packing.pack_documents(docs.limit(40), 128, with_ids=True)
    pieces = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert bytes(r["ids"]) == b"".join(v for k, v in sorted(pieces.items()) if k[0] == r["sequence_id"])
        assert len(r["ids"]) == 4 * r["length"] <= 512


@pytest.mark.parametrize("sizes", [{7: 6, 5: 6}, {6: 4, 4: 3, 3: 5, 2: 2}, {5: 3, 4: 3, 3: 3}, {1: 25}, {10: 4}, {}])
def test_local_search_never_adds_bins(sizes):
    first = packing.best_fit(sizes, 10)
    last = packing.local_search(first, 10)
    for bins in (first, last):
        assert sum((Counter({s: n * m for s, n in i.items()}) for i, m in bins), Counter()) == Counter(sizes)
        assert all(sum(s * n for s, n in i.items()) <= 10 for i, _ in bins)
    assert sum(m for _, m in last) <= sum(m for _, m in first)


def test_local_search_empties_a_bin():
    # 6+3, 5+4 and 1+1 fit into two bins after an exchange
    bins = [(Counter({6: 1, 3: 1}), 1), (Counter({5: 1, 4: 1}), 1), (Counter({1: 2}), 1)]
    assert sum(m for _, m in packing.local_search(bins, 10)) == 2


def test_levels_are_addressable():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 5000), np.zeros(3, int), np.array([], int), np.array([2**32 - 1, 0, 255, 256])):
        for width in (4, 8, 12):
            lv = token_files.Levels(token_files.encode_levels(ids.astype(np.uint32), width))
            assert lv.all().tolist() == ids.tolist()
            assert [lv.get(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()


def check_tokens(got, rows):
    t = tok("word_bpe_49k.json")
    at = 0
    for r, (_, text) in zip(got.sort_values("start").itertuples(), rows, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files(spark, data, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = token_files.op5_token_files(spark, data).toPandas()
    assert got.sort_values("start")["doc_id"].tolist() == [d for d, _ in rows]
    check_tokens(got, rows)


def test_token_files_awkward(spark, awkward, none, tmp_path):
    path = tokens.public_path("word_bpe_49k.json")
    token_files.write_tokens(awkward.where("doc_id is null or doc_id <> 2"), str(tmp_path / "a"), path, 1, True, segment=50)
    rows = sorted([(r["doc_id"], r["text"]) for r in awkward.collect() if r["doc_id"] != 2], key=lambda x: -1 if x[0] is None else x[0])
    check_tokens(token_files.read_tokens(spark, str(tmp_path / "a")).toPandas(), rows)
    token_files.write_tokens(none, str(tmp_path / "b"), path, 1, True)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_targets():
    assert mixing.targets([10, 10], [1, 1]) == [10, 10]
    assert mixing.targets([10, 100], [5, 2]) == [30, 80]
    t = mixing.targets([5, 40, 0, 100], [5, 2, 1, 5])
    assert t[2] == 0 and t[0] == 15 and abs(sum(t) - 145) < 1e-9


def check_mix(got):
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.5001 or g["taken"].sum() == 3 * g["size"].sum()
        assert g["source_size"].iloc[0] == g["size"].sum()
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()


def test_mixing(spark, data, docs):
    got = mixing.op7_mixing(spark, data).toPandas()
    want = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    assert dict(zip(got["doc_id"], got["size"], strict=True)) == want
    check_mix(got)
    again = mixing.op7_mixing(spark, data).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mixing_awkward(awkward, none):
    sized = awkward.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    out, takes = mixing.mix(sized, block=16)
    got = out.toPandas()
    assert len(got) == 11
    check_mix(got)
    assert takes.agg(F.sum(F.col("last") - F.col("first"))).first()[0] == got["taken"].sum()
    assert mixing.mix(none.select("doc_id", "source", F.lit(0).cast("long").alias("size")))[0].count() == 0


def test_schedule_is_even(spark):
    """After any number of slots each source is within a few of its share."""
    from querywright.llm.common import Scratch

    slots = [500, 300, 200, 7]
    rows = sorted((r["slot"], r["source_index"], r["turn"]) for r in mixing.schedule(spark, slots, Scratch(spark)).collect())
    assert Counter(s for _, s, _ in rows) == Counter(dict(enumerate(slots)))
    have = Counter()
    for n, (_, s, turn) in enumerate(rows[:900], 1):
        assert turn == have[s]
        have[s] += 1
        assert all(abs(have[k] - n * q / 1007) < 6 for k, q in enumerate(slots))


def exchange(low: Counter, high: Counter, room: int, lead: int) -> tuple[Counter, Counter] | None:
    """What to move from the emptier bin to the fuller one, and back, that raises the fuller one most.

    ``lead`` is how much fuller it is; any gain d with 1 <= d <= room raises the sum of squares."""
    gives = [(a,) for a in low] + [(a, b) for a in low for b in low if a < b or a == b and low[a] > 1]
    takes: list[tuple] = [()] + [(b,) for b in high] + [(a, b) for a in high for b in high if a < b or a == b and high[a] > 1]
    totals = np.array([sum(t) for t in takes])
    order = np.argsort(totals, kind="stable")
    best = None
    for g in gives:
        # the smallest return that leaves the gain within the room
        at = np.searchsorted(totals[order], sum(g) - room)
        while at < len(order):
            t = takes[order[at]]
            gain = sum(g) - sum(t)
            if gain <= 0:
                break
            if len(g) + len(t) <= 3 and (gain > -lead):
                if best is None or gain > best[0]:
                    best = (gain, Counter(g), Counter(t))
                break
            at += 1
    return best and best[1:]


@pytest.mark.parametrize("seed", [1, 3, 5])
def test_local_search_leaves_no_exchange(seed):
    """No two patterns are left that an exchange improves, beyond the emptiest and fullest ones too."""
    from querywright.llm import packing

    rng = np.random.default_rng(seed)
    sizes = {int(s): int(rng.integers(1, 30)) for s in rng.choice(np.arange(150, 1024), 60, replace=False)}
    bins = [(items, m, sum(s * n for s, n in items.items())) for items, m in packing.pack_histogram(sizes, 1024)]
    under = [b for b in bins if b[2] < 1024]
    pairs = [(a, b) for a in under for b in under if b[2] >= a[2] and (a is not b or a[1] > 1)]
    assert len(under) > 16 and not any(exchange(a[0], b[0], 1024 - b[2], b[2] - a[2]) for a, b in pairs)
    assert {s: sum(i[s] * m for i, m, _ in bins) for s in sizes} == sizes
