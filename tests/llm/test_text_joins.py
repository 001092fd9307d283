"""N-gram join, repeated passages, classifiers and the pipeline against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from querywright.llm import batch_counts as bc
from querywright.llm import ngram_join as nj
from querywright.llm import quality, suffix_dedup, toxicity
from querywright.llm.common import Scratch, components
from querywright.llm.packing import pack_documents
from querywright.llm.weak_labels import LabelModel

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("x", "st", "ng", "rd", "ll", "m")]


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for pair in {(a, b) for ds in where.values() for a in ds for b in ds if a < b}:
        both = len(sets[pair[0]] & sets[pair[1]])
        if 100 * both >= 80 * (len(sets[pair[0]]) + len(sets[pair[1]]) - both):
            a, b = map(root, pair)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_rows(seed, n):
    """Texts with chains of near copies around the threshold."""
    rng = random.Random(seed)
    rows, base = [], None
    for i in range(n):
        if base is None or rng.random() < 0.25:
            base = [rng.choice(WORDS) for _ in range(rng.choice([3, 5, 8, 20, 60, 120, 300]))]
        words = list(base)
        for _ in range(rng.randint(0, max(1, len(words) // 40))):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i * 7 % n, " ".join(words)))
        if rng.random() < 0.3:
            base = words
    return rows


def answer(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_join_on_documents(spark, data, docs):
    assert answer(nj.op4_ngram_join(spark, data)) == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize(("chunk", "whole"), [(1024, 32), (7, 100), (5, 1)])
def test_join_of_chains(spark, chunk, whole):
    """In whole families, in pairs of blocks, and by first shingle."""
    rows = near_rows(5, 400)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(nj.similar_documents(df, chunk=chunk, whole=whole)) == brute_components(rows)


def test_join_of_a_hot_group(spark, monkeypatch):
    """A third are near copies of one text, and shingles are common within a batch."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = near_rows(6, 300)
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = rng.choice(WORDS)
        rows.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert answer(nj.similar_documents(df, chunk=40)) == brute_components(rows)


def test_join_awkward(awkward, none):
    got = answer(nj.similar_documents(awkward))
    assert got[1] == got[2] == (3, 1) and got[3] == got[4] == (0, got[3][1]) or got[3] == (0, 3)
    assert got[5] == (1, 5) and got[8] == (1, 8) and got[None] == (1, None)
    assert nj.similar_documents(none).count() == 0


def test_join_with_repeated_ids(spark):
    """Each text of a doc_id keeps its links, and ties those of the others to them."""
    rows = near_rows(12, 240)
    rows = [(d // 3 * 3 if d % 5 == 0 else d, t) for d, t in rows] + [(7, None), (7, ""), (500, ""), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.similar_documents(df).collect() if r["doc_id"] is not None)
    known = [(d, t) for d, t in rows if d is not None]
    alone = brute_components([(k, t) for k, (_, t) in enumerate(known)])
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (d, _) in enumerate(known):
        parent[root(("set", alone[k][1]))] = root(("doc", d))
    least = {}
    for d, _ in known:
        least[root(("doc", d))] = min(d, least.get(root(("doc", d)), d))
    want = sorted((d, alone[k][0], least[root(("doc", d))]) for k, (d, _) in enumerate(known))
    assert got == want and len({d for d, _ in known}) < len(known) - 20 and 20 < len(least) < 120


def test_counts_come_back():
    """Each document of a batch gets its shared shingles, rarest first, however common they are in the batch."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS[:6]) for _ in range(rng.choice([3, 9, 30]))) + " and so say all of us" * (k % 3 > 0) for k in range(400)]
    heads, parts, senders = {}, defaultdict(list), []
    for part in range(2):
        to = bc.Sender(part, 4, True)
        for k, t in enumerate(texts[part::2]):
            to.add(2 * k + part, *nj.sized_shingles(t))
        senders.append(to.flush())
    for s in range(4):
        rows = [r for b in senders for r in b.to_pylist() if r["slice"] == s]
        heads |= {r["batch"]: r["body"] for r in rows if r["kind"] == 0}
        for batch, _, body in bc.counted([(r["batch"], r["body"]) for r in rows if r["kind"]]):
            parts[batch].append(bc.unpacked(body))
    got = [r for batch, head in heads.items() for r in nj.gathered(bc.unpacked(head), parts[batch]).to_pylist()]
    sets = [nj.shingles(t) for t in texts]
    sent = {(k % 2, s.tobytes()): k for k, s in reversed(list(enumerate(sets)))}
    df = defaultdict(int)
    for k in sent.values():
        for x in sets[k].tolist():
            df[x] += 1
    assert max(df.values()) > 2 * bc.COMMON and len(got) == 400 and len(sent) < 400
    for r in got:
        s = sets[r["doc_id"]].tolist()
        shared = sorted((df[x], x) for x in s if df[x] > 1)
        left = len(shared) - nj.needed(len(s)) + 1
        assert r["n"] == len(s)
        if left > 0 and r["doc_id"] in sent.values():
            assert r["first"] == [x for _, x in shared[:left]] and bc.joined_gaps(*bc.unpacked(r["tokens"])).tolist() == sorted(x for _, x in shared)
        else:
            assert r["first"] is None and r["tokens"] is None


def test_tree_prunes_nothing_linked():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, 120).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[: len(s) - 5], rng.integers(1000, 1 << 40, 4).astype(np.uint64)])) for s in sets[:30]]
    tree = nj.CountTree(np.stack([nj.counts(s) for s in sets]), np.array([len(s) for s in sets]))
    found = {(min(i, j), max(i, j)) for a, b in tree.pairs(tree, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i) if nj.linked(sets[i], sets[j])}
    assert {(j, i) for i, j in want} <= found and len(found) < len(sets) ** 2 / 4


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def brute_removal(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        windows = [raw[i : i + 50] for i in range(len(raw) - 49)]
        gone = bytearray(len(raw))
        for i, w in enumerate(windows):
            if w in seen:
                gone[i : i + 50] = b"\1" * 50
        seen.update(windows)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removal(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()}


def test_removal_on_documents(spark, data, docs):
    got = {r["doc_id"]: tuple(r[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.op8_suffix_dedup(spark, data).collect()}
    assert got == brute_removal([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_removal_of_overlaps(spark, seed):
    """Passages cut at random places, periodic texts, edges of exactly 49 to 51 bytes."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd é") for _ in range(300)) for _ in range(4)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(200)
            parts += [p[a : a + rng.choice([48, 49, 50, 51, 90])], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9)))]
        rows.append((d, "".join(parts) if d % 9 else "ab" * rng.randint(10, 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert removal(df) == brute_removal(rows)


def test_removal_with_repeated_ids(spark):
    """Texts of one doc_id lose what smaller doc_ids hold of each, whatever the other's length."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    p, q = text(120), text(90)
    rows = [(1, p), (1, q), (2, text(400) + p), (2, q + text(20)), (2, "short"), (2, text(60) + q[:70]), (3, p), (3, p), (3, text(500)), (4, text(30) + p + q)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeats(df).collect())
    want = []
    for d, t in rows:
        seen = {u[i : i + 50] for e, u in rows if e < d for i in range(len(u) - 49)}
        gone = {i + k for i in range(len(t) - 49) if t[i : i + 50] in seen for k in range(50)}
        want.append((d, len(t), len(gone), sum(i - 1 not in gone for i in gone), "".join(c for i, c in enumerate(t) if i not in gone)))
    assert got == sorted(want) and sum(x[2] for x in want) > 600


def test_merge_is_the_order_of_all_suffixes():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 80))).encode() for _ in range(24)]
    shard_of = np.arange(24) % 5
    holders = np.array([rng.randrange(6) for _ in strings])
    s, place = suffix_dedup.repeated(strings, holders, shard_of, 8)
    want = set()
    for i, x in enumerate(strings):
        for p in range(len(x) - 7):
            if any(x[p : p + 8] in y and holders[j] < holders[i] for j, y in enumerate(strings)):
                want.add((i, p))
    assert set(zip(s.tolist(), place.tolist(), strict=True)) == want


def test_removal_awkward(awkward, none):
    got = suffix_dedup.remove_repeats(awkward).toPandas()
    assert len(got) == 11 and got["n_removed"].sum() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    right = [0.95, 0.9, 0.8, 0.6]
    votes = np.stack([np.where(rng.random(len(y)) < r, y, ~y) for r in right], 1).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = LabelModel().fit(patterns, counts.astype(float), np.stack([1 - (p := np.where((patterns == 1).sum(1) > (patterns == 0).sum(1), 0.8, 0.2)), p], 1))
    assert np.allclose(m.rate[1, :, 1], right, atol=0.03) and np.allclose(m.rate[0, :, 0], right, atol=0.05)


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["keep"] for r in quality.op9_quality(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert len(got) == 1000 and np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_toxicity_held_out(spark):
    import zlib

    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, d).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for k, r in got.items())
    rows = [(r["toxic"], got[r["doc_id"]]) for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").collect() if got[r["doc_id"]]["held_out"]]
    hit = [g["predicted"] for t, g in rows if t == 1]
    false = [g["predicted"] for t, g in rows if t == 0]
    assert np.mean(hit) > 0.9 and np.mean(false) < 0.02


def test_classifiers_awkward(spark, awkward, none):
    got = quality.quality_scores(awkward).toPandas()
    assert len(got) == 11 and not got[got["doc_id"] == 3]["keep"].iloc[0]
    labels = spark.createDataFrame([(1, None), (7, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(awkward, labels).count() == 11
    assert toxicity.toxicity_scores(awkward, labels.limit(0)).count() == 11
    assert quality.quality_scores(none).count() == 0 and toxicity.toxicity_scores(none, labels).count() == 0


def test_pipeline_stages(spark, data, docs, tmp_path):
    """Each stage against its plain meaning on what the one before it kept."""
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, before, data).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert now.columns == corpus_pipeline.COLUMNS
        old = {r["doc_id"]: r["text"] for r in before.collect()} if name != "packing" else {}
        if name == "near_duplicates":
            want = {d for d, (_, c) in brute_components(list(old.items())).items() if c == d}
            assert {r["doc_id"] for r in now.collect()} == want
        if name == "repeated_passages":
            want = {d for d, (n, gone, _, _) in brute_removal(list(old.items())).items() if gone < n or not n}
            assert {r["doc_id"] for r in now.collect()} == want
        if name == "mixing":
            rows = now.collect()
            assert all(len(r["text"]) == r["n_chars"] and old[r["doc_id"]].startswith(r["text"]) for r in rows)
            total = sum(len(t.encode().split()) for t in old.values())
            assert abs(sum(len(r["text"].encode().split()) for r in rows) - total) <= 20
    whole = pack_documents(before).groupBy("sequence_id").sum("length").toPandas()
    assert now.count() == pack_documents(before).count() and whole["sum(length)"].max() <= 1024
    assert corpus_pipeline.run(spark, data).count() == now.count()


def test_pipeline_texts(spark, data, docs, tmp_path):
    """Texts that stage 3 leaves, words that each source of the mix has, and places of packed pieces."""
    old = [(r["doc_id"], r["text"]) for r in docs.collect()]
    seen, want = set(), {}
    for d, t in sorted(old):
        raw = (t or "").encode()
        windows = [raw[i : i + 50] for i in range(len(raw) - 49)]
        gone = {i + k for i, w in enumerate(windows) if w in seen for k in range(50)}
        seen.update(windows)
        if len(gone) < len(raw) or not raw:
            want[d] = bytes(c for i, c in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
    left = corpus_pipeline.repeated_passages(spark, docs, data)
    left.write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    rows = left.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == len(want)

    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(r["text"].encode().split())
    names = sorted(sizes)
    goal, held = {}, {}
    while True:
        free = [k for k in range(len(names)) if k not in held]
        rest, total = sum(sizes.values()) - sum(held.values()), sum((5, 2, 1)[k % 3] for k in free)
        goal = held | {k: rest * (5, 2, 1)[k % 3] / total for k in free}
        over = {k: 3.0 * sizes[names[k]] for k in free if goal[k] > 3 * sizes[names[k]]}
        if not over:
            break
        held |= over
    mixed = corpus_pipeline.mixing(spark, left, data)
    mixed.write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].encode().split())
    assert all(abs(taken[n] - goal[k]) <= 1 for k, n in enumerate(names))

    places = defaultdict(list)
    for r in corpus_pipeline.packing(spark, mixed, data).collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(places) == list(range(len(places)))
    for p in places.values():
        ends = [a + n for a, n in sorted(p)]
        assert [a for a, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_pipeline_awkward(spark, awkward, none, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows and ids, and clashing columns."""
    more = [(2, "another text of the same id", "fr", "b", 27, 0, "y"), (None, "no id either", "fr", "b", 12, 0, "z"), (None, "no id here", "en", "a", 10, 0, "x")]
    rows = awkward.union(spark.createDataFrame(more, awkward.schema))
    old = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, "").write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name)).collect()
        if name == "near_duplicates":
            # Text 2 has an own text besides one that is linked with text 1, so that both ids are one component.
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((d or 0, t or "") for d, t, _, _ in old if d != 2)
        if name == "repeated_passages":
            assert {(r["doc_id"], r["lang"], r["source"]) for r in got} == {(d, lang, s) for d, _, lang, s in old}
            assert len(got) == len(old)
        if name == "mixing":
            texts = {(r["doc_id"], r["source"], r["lang"]): {t for d, t, lang, s in old if (d, s, lang) == (r["doc_id"], r["source"], r["lang"])} for r in got}
            assert all(any(t and t.startswith(r["text"]) for t in texts[r["doc_id"], r["source"], r["lang"]]) for r in got)
            words = lambda t: len((t or "").encode().split())
            total = sum(words(t) for _, t, _, _ in old)
            assert abs(sum(words(r["text"]) for r in got) - total) <= 4
            # Equal rows share what is taken: each of the three null ids with words has its own text.
            assert {r["text"] for r in got if r["doc_id"] is None} <= {"no id here", "no id either", "no id", "no"}
        if name == "packing":
            assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and sum(r["doc_id"] is None for r in got) == 3
        if name != "packing":
            assert stage(spark, none, "").count() == 0 and set(got[0].asDict()) == set(corpus_pipeline.COLUMNS)
        else:
            assert stage(spark, none, "").count() == 0


def test_clashing_columns(spark, awkward):
    """Columns that have the names of results are replaced."""
    from querywright.llm import mixing, sharding

    rows = awkward.selectExpr("doc_id", "text", "source", "1 AS score", "2 AS keep", "3 AS hilbert", "4 AS shard", "5 AS target", "6 AS source_size", "7 AS name", "8 AS rank", "coalesce(n_chars, 0) AS size")
    got = quality.quality_scores(rows).select("doc_id", "score", "keep").collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    got = sharding.hilbert_shards(rows, ["source", "doc_id"], ["doc_id", "text"]).select("hilbert", "rank", "shard", "slot", "size").toPandas()
    assert sorted(got["rank"]) == list(range(11))
    got = mixing.mix(rows)[0].select("source", "target", "source_size", "taken").toPandas()
    assert got.drop_duplicates("source")["source_size"].sum() == rows.selectExpr("sum(size)").first()[0]
