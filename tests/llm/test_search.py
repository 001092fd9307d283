"""Edit fingerprints and vector search against brute force."""

import hashlib

import numpy as np
import pytest

from querywright.llm import edit_fingerprint as ef
from querywright.llm import vector_search as vs

from .conftest import AWKWARD


def slow_walk(text):
    """The walk one step at a time."""
    if not ef._STAYS:
        ef._STAYS.append(ef._stays())
    t, out = 0, []
    for c in text:
        out.append(t)
        k = (ord(c) * 2654435761 & 0xFFFFFFFF) >> 24
        t += int(ef._STAYS[0][k * ef.PERIOD + t % ef.PERIOD])
    return out, t


def test_walk():
    texts = ["", "a", "hello world " * 30, "hellO world " * 30, "ñandú"]
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    n = np.array([len(c) for c in codes])
    off = np.concatenate([[0], np.cumsum(n)[:-1]])
    came, ends = ef.walk(np.concatenate(codes), off, n)
    for t, o, k, e in zip(texts, off, n, ends, strict=True):
        assert (came[o : o + k].tolist(), int(e)) == slow_walk(t)


def test_walk_falls_into_step():
    """One inserted character costs little of the likeness; unrelated texts have none."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    a, b = (" ".join(word() for _ in range(600)) for _ in range(2))
    fa, fb, fi = ef.fingerprints([a, b, a[:500] + "Z" + a[500:]])
    assert ef.likeness(fa, fi) > 0.85 and ef.likeness(fa, fb) < 0.2 and ef.likeness(fa, fa) == 1
    half = ef.fingerprints([ef.edited(a, b)])[0]
    assert 0.3 < ef.likeness(fa, half) < 0.7


def test_neighbours(spark, data, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in ef.op3_edit_fingerprints(spark, data).collect()}
    assert len(got) == len(rows)
    prints = ef.fingerprints([t for _, t in rows])
    for k, (d, t) in enumerate(rows):
        j = (k + 1) % len(rows)
        e = t[: len(t) - len(t) // 2] + rows[j][1][: len(t) // 2]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == prints[k] and r["edited_fingerprint"] == ef.fingerprints([e])[0]
        assert r["near_edited"] == ef.likeness(prints[k], r["edited_fingerprint"]) and r["near_next"] == ef.likeness(prints[k], prints[j])
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.3


def test_neighbours_awkward(awkward, none):
    got = ef.neighbour_fingerprints(awkward.repartition(5)).toPandas()
    assert len(got) == 11 and got["fingerprint"].nunique() == len({r[1] or "" for r in AWKWARD})
    assert ef.neighbour_fingerprints(none).count() == 0
    assert ef.neighbour_fingerprints(awkward.where("doc_id = 5")).first()["near_next"] == 1


@pytest.mark.parametrize("a,b,d", [("", "", 0), ("", "abc", 3), ("kitten", "sitting", 3), ("abc", "abc", 0), ("flaw", "lawn", 2)])
def test_distance(a, b, d):
    assert ef.distance(a, b) == ef.distance(b, a) == d


def test_near_texts(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 6
    rows = [(1, base), (2, base[:200] + "XY" + base[200:]), (3, base), (4, "nothing like it at all, " * 12), (5, None), (6, base.replace("lazy", "idle", 2))]
    got = {(r["a"], r["b"]) for r in ef.near_texts(spark.createDataFrame(rows, "doc_id long, text string"), 0.9).collect()}
    assert {(1, 2)} <= got <= {(1, 2), (1, 6), (2, 6)} and len(got) >= 2


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def scattered(rng, n, share, letters="abcdefghijklmnopqrstuvwxyz"):
    """A random text and a copy with so many letters exchanged."""
    a = rng.choice(list(letters), n)
    b = a.copy()
    b[rng.choice(n, int(n * share), replace=False)] = rng.choice(list(letters), int(n * share))
    return "".join(a), "".join(b)


def brute_near(rows, least):
    """Pairs of the first doc_ids of different texts, by the plain table of edit distances."""
    first = {}
    for d, t in rows:
        first[t or ""] = min(d, first.get(t or "", d))
    items = sorted(first.items(), key=lambda x: x[1])
    out = {}
    for i, (t, a) in enumerate(items):
        for u, b in items[i + 1 :]:
            n = max(len(t), len(u), 1)
            if abs(len(t) - len(u)) <= (1 - least) * n + 1 and (s := 1 - plain_distance(t, u) / n) >= least:
                out[a, b] = s
    return out


@pytest.mark.parametrize("chunk", [256, 7])
def test_near_texts_with_scattered_edits(spark, chunk):
    """All pairs down to the threshold, 10 to 20 % of the letters being exchanged."""
    rng = np.random.default_rng(8)
    texts = [t for n in (8, 40, 130, 200) for share in (0.1, 0.15, 0.2) for t in scattered(rng, n, share)]
    rows = list(enumerate([*texts, "", None, "a", "ab", "abcde", "abcdx", texts[0], texts[6][:90] + texts[6][110:]]))
    got = {(r["a"], r["b"]): r["similarity"] for r in ef.near_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk=chunk).collect()}
    want = brute_near(rows, 0.8)
    assert got == want and len(want) >= 10


def test_band_recall():
    """Share of pairs with a band in common, near the threshold (README gives the figures)."""
    rng = np.random.default_rng(9)
    for share, least in ((0.05, 0.9), (0.1, 0.8), (0.19, 0.6)):
        pairs = [scattered(rng, 300, share) for _ in range(60)]
        a, b = (ef.bands([p[k] for p in pairs], 1) for k in (0, 1))
        assert np.mean([np.intersect1d(x, y).size > 0 for x, y in zip(a, b, strict=True)]) >= least


@pytest.mark.parametrize("exact,chunk", [(True, 256), (False, 256), (False, 3)])
def test_near_texts_of_a_hot_band(spark, exact, chunk):
    """Twelve texts open alike, so share bands; all near pairs of each half are found, and copies are members."""
    rng = np.random.default_rng(6)
    opening = scattered(rng, 60, 0)[0]
    one, two = (opening + scattered(rng, 120, 0)[0] for _ in range(2))
    texts = [t[: 70 + 7 * k] + "#" + t[71 + 7 * k :] for k in range(6) for t in (one, two)]
    rows = [*enumerate([*texts, texts[3], None, "", texts[3]]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["a"], r["b"]): r["similarity"] for r in ef.near_texts(df, exact=exact, chunk=chunk).collect()}
    assert got == brute_near(rows[:-1], 0.8) and len(got) == 30
    same = {r["doc_id"]: r["first"] for r in ef.same_texts(df).collect()}
    assert same == {**{d: d for d in range(12)}, 12: 3, 13: 13, 14: 13, 15: 3}


def brute(rows, every, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.nonzero(ids % every == 0)[0]:
        s = x @ x[i]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in sorted(np.nonzero(ids != ids[i])[0], key=lambda j: (-s[j], ids[j]))[:k]]
    return out


def test_hadamard_turns_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = vs.rotate(x, 3)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(x @ x.T, y @ y.T)


def test_recall(spark, data):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    got = {}
    for r in vs.op6_vector_search(spark, data).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == want.keys()
    x = dict(rows)
    hit = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, len(found) + 1))
        hit += len({v for v, _ in found.values()} & {v for v, _ in want[q]})
        for v, s in found.values():
            assert abs(s - np.dot(np.array(x[q], np.float64), np.array(x[v], np.float64))) < 1e-12
    assert hit >= 0.9 * 20 * len(want)


def test_vectors_awkward(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6) * (1 + i % 3)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1])]
    odd = [(300, None), (320, [0.0] * 6), (340, [float("nan")] + [1.0] * 5), (360, [1.0, None] + [1.0] * 4), (380, [float("inf")] + [0.0] * 5), (400, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, entry int")
    got = {}
    for r in vs.nearest(df, k=20, every=20, recall=1.0, chunk=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {q: [v for v, _ in x] for q, x in brute(rows[:-1], 20, 20).items()}
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    assert got[200] == want[200]
    assert vs.nearest(df.where("vec_id = 300")).count() == 0
    few = vs.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]
