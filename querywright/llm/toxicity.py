"""Operator 10: toxicity by weak supervision.

From labelled rows (about ``sample`` of them, drawn by hash) lexicons of words and word beginnings are
drawn up, one for each length, split over two halves of the rows, so that no lexicon votes on what it
was drawn from alone.  The lexicons, their density, patterns (lexicon words behind masked or stretched spellings,
repeated marks) and the given label itself are voters; a
generative model estimates their accuracies and discounts those that repeat one another, and its
posteriors, which mend wrong labels, train a linear classifier on hashed words and word beginnings.

Only the text is scored; columns besides doc_id and text are not read.  Rows that repeat get equal scores.  Rows whose crc32(doc_id) mod 3 is 1 are held out, and rows without a
label are not learnt from.  Null and empty texts get the score of a text without signs.
A table without labels scores every text alike, below the threshold; an empty one gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, documents, small_batches, tidy
from .weak_labels import LabelModel, feature, train_linear

BITS = 20
FEATURE = (1 << BITS) - 1
LENGTHS = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")
#: Kinds of signs that pattern voters look at, after those of whole words and beginnings.
MASKED, STRETCHED = len(LENGTHS) + 1, len(LENGTHS) + 2
_MASK = re.compile(r"[^\W\d_][0134578@$!*._-]+[^\W\d_]")
_UNMASK = str.maketrans("0134578@$!", "oieastbasi", "*._-")
_STRETCH = re.compile(r"(.)\1{2,}")
_MARKS = re.compile(r"[!?]{2,}")


def held_out(c: Column) -> Column:
    return F.pmod(F.crc32(c.cast("string")), F.lit(3)) == 1


def signs(token: str) -> list[tuple[int, int]]:
    """(kind, hashed feature) of the words of a token: whole (kind 0) and beginnings by length, and both of
    the word behind a spelling with masks (d1gits, sym*bols) or stretched letters."""
    out = []
    for w in _WORD.findall(token):
        out.append((0, feature("=" + w, BITS)))
        out += [(k, feature(w[:n], BITS)) for k, n in enumerate(LENGTHS, 1) if len(w) >= n]
    for kind, found, plain in ((MASKED, _MASK, lambda t: t.translate(_UNMASK)), (STRETCHED, _STRETCH, lambda t: _STRETCH.sub(r"\1", t))):
        if found.search(token):
            for w in _WORD.findall(plain(token)):
                out += [(kind, feature("=" + w, BITS)), *((kind, feature(w[:n], BITS)) for n in LENGTHS if len(w) >= n)]
    return out


class Signs(dict):
    """Remembers the signs of tokens that matter, as kind and feature in one number; forgets all beyond ``most``."""

    def __init__(self, wanted=None, most: int = 100_000):
        self.wanted, self.most = wanted, most

    def __missing__(self, token: str):
        if len(self) >= self.most:
            self.clear()
        found = tuple(k << BITS | f for k, f in signs(token) if self.wanted is None or f in self.wanted)
        self[token] = found
        return found


def tokens(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def _odds(rows, y, pick):
    """Log odds of each feature among picked rows, and how many toxic and clean rows have it."""
    hit = np.zeros((2, 1 << BITS), np.int64)
    for c in (0, 1):
        some = [r for r, t, p in zip(rows, y, pick, strict=True) if p and t == c]
        for i in range(0, len(some), 512):
            hit[c] += np.bincount(np.concatenate(some[i : i + 512]), minlength=1 << BITS)
    n = [max(1, int((pick & (y == c)).sum())) for c in (0, 1)]
    return np.log((hit[1] + 0.2) / n[1]) - np.log((hit[0] + 0.2) / n[0]), hit[1], hit[0]


def learn_from(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float, LabelModel]:
    known = Signs()
    found = [distinct(np.fromiter(chain.from_iterable(map(known.__getitem__, tokens(x))), np.int32)) for x in texts]
    rows = [distinct(s & FEATURE) for s in found]
    y = np.asarray(labels, np.int64)
    half = np.arange(len(y)) % 2
    lexicon = []
    for side in (0, 1):
        odds, bad, _ = _odds(rows, y, half == side)
        lexicon.append((odds > 2.0) & (bad >= 4))
    ballots = np.full((len(y), len(LENGTHS) + 6), -1)
    for i, s in enumerate(found):
        # rows are judged by the lexicon of the other half
        hits = s[lexicon[1 - half[i]][s & FEATURE]]
        kinds = np.bincount(hits >> BITS, minlength=STRETCHED + 1) > 0
        ballots[i, : len(LENGTHS) + 1] = kinds[: len(LENGTHS) + 1]
        for k in (MASKED, STRETCHED):
            ballots[i, k] = 1 if kinds[k] else -1
        ballots[i, -3] = 1 if _MARKS.search(texts[i] or "") else -1
        ballots[i, -2] = 1 if len(distinct(hits & FEATURE)) >= 6 else 0 if not len(hits) else -1
    ballots[:, -1] = y
    patterns, inverse, counts = np.unique(ballots, axis=0, return_inverse=True, return_counts=True)
    first = np.array([0.9 if p[-1] == 1 else 0.05 for p in patterns])
    model = LabelModel().fit(patterns, counts.astype(float), np.stack([1 - first, first], 1), correlated=True)
    post = model.posterior(patterns)[inverse.ravel()]
    # Only signs that tell classes apart have a weight; the rest of the vocabulary has none.
    odds, bad, good = _odds(rows, (post >= 0.5).astype(np.int64), np.ones(len(y), bool))
    # Signs of clean texts have no weight, so that what surrounds a toxic passage cannot hide it.
    useful = (odds > 1.0) & (bad + good >= 8) & (bad >= 6)
    rows = [r[useful[r]] for r in rows]
    values = [np.minimum(odds[r], 4.0) / 4 for r in rows]
    w, b = train_linear(rows, values, post, np.ones(len(y)), 1 << BITS, rounds=200, shrink=1e-5)
    return w * np.minimum(odds, 4.0) / 4 * useful, b, model


def toxicity_scores(df: DataFrame, labels: DataFrame, sample: int = 16_000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``df(doc_id, text)``."""
    small_batches(df.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    # About ``sample`` rows, however many labels there are: safe to broadcast.
    drawn = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) < share))

    def learn(batches):
        texts, y, order = [], [], []
        for b in batches:
            order += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
            y += b.column(2).to_pylist()
        at = sorted(range(len(order)), key=lambda i: (order[i], texts[i] or ""))
        w, bias, _ = learn_from([texts[i] for i in at], np.array([y[i] for i in at]))
        on = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([on.astype(np.int32).tobytes()], pa.binary()), pa.array([w[on].tobytes()], pa.binary()), pa.array([bias])], ["on", "w", "b"])

    picked = df.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "text", F.col("toxic").cast("int"))
    got = picked.repartition(1).mapInArrow(tidy(learn), "on binary, w binary, b double").first() if n else None
    weights = dict(zip(np.frombuffer(got["on"], np.int32).tolist(), np.frombuffer(got["w"]).tolist(), strict=True)) if got else {}
    bias = got["b"] if got else -2.0

    def score(batches):
        known = Signs(weights)
        for b in batches:
            z = []
            for text in b.column(1).to_pylist():
                seen = {s & FEATURE for t in tokens(text) for s in known[t]}
                z.append(bias + sum(weights[f] for f in sorted(seen)))
            s = 1 / (1 + np.exp(-np.clip(np.array(z), -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = df.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(tidy(score), "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
