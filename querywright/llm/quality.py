"""Operator 9: quality by weak labels.

Ten overlapping heuristics vote good, bad or nothing on each text.  Expectation-maximisation over the
counts of all vote patterns (at most 3**10, whatever the corpus) estimates how often each labeller
votes what on good and on bad texts, and so a posterior for each pattern.  The posteriors train a
linear scorer on hashed word shapes and binned statistics, fitted on about ``sample`` texts drawn by
hash of doc_id from all rows; every text is scored whole.

Null and empty texts have no words and are rejected with score 0.  Rows that repeat get equal scores.
Columns besides doc_id and text are carried along, but for ``score``, ``posterior`` and ``keep``, which are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, tidy
from .weak_labels import NONE, LabelModel, feature, train_linear

BITS = 14
_SYMBOLS = np.frombuffer(b"#$%&*|~^=<>{}@\\", np.uint8)
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"([aA0])\1+")
LABELLERS = ("capitals", "symbols", "exclamation", "bars", "variety", "commonest", "stutter", "lines", "sentences", "word_length")


def statistics(text: str | None) -> dict[str, float]:
    """What the labellers look at; NaN where a text is too short to say."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n = len(words)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    nan = float("nan")
    lines = raw.split(b"\n")
    ends = int(byte[46] + byte[63] + byte[33])
    return {
        "words": n,
        "capitals": upper / (upper + lower) if upper + lower >= 20 else nan,
        "symbols": int(byte[_SYMBOLS].sum()) / len(raw) if raw else nan,
        "exclamation": int(byte[33]) / n if n else nan,
        "bars": int(byte[124]) / n if n else nan,
        "variety": len(set(words)) / n if n >= 30 else nan,
        "commonest": max(Counter(words).values()) / n if n >= 15 else nan,
        "stutter": sum(map(operator.eq, words, words[1:])) / n if n >= 8 else nan,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else nan,
        "sentences": n / ends if ends else 1000.0 if n >= 30 else nan,
        "word_length": len(raw) / n if n else nan,
    }


#: For each labeller: values that mean good, and beyond which they mean bad.
RANGES = {
    "capitals": ((0, 0.2), (0, 0.5)),
    "symbols": ((0, 0.005), (0, 0.03)),
    "exclamation": ((0, 0.03), (0, 0.3)),
    "bars": ((0, 0.01), (0, 0.1)),
    "variety": ((0.5, 1), (0.3, 1)),
    "commonest": ((0, 0.13), (0, 0.25)),
    "stutter": ((0, 0.06), (0, 0.25)),
    "lines": ((0, 0.34), (0, 0.6)),
    "sentences": ((2, 60), (0.9, 300)),
    "word_length": ((3.5, 14), (2, 30)),
}


def votes(s: dict[str, float]) -> list[int]:
    out = []
    for name in LABELLERS:
        v, ((a, b), (c, d)) = s[name], RANGES[name]
        out.append(NONE if v != v else 1 if a <= v <= b else 0 if not c <= v <= d else NONE)
    return out


def features(text: str | None, s: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, and each statistic's bin."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    shapes = Counter(_RUN.sub(rb"\1", raw.translate(_SHAPE)).split())
    n = max(1, sum(shapes.values()))
    x: dict[int, float] = {}
    for shape, k in shapes.items():
        f = feature(b"shape " + shape, BITS)
        x[f] = x.get(f, 0) + k / n
    for name, v in s.items():
        if name == "words" or v != v:
            continue
        (a, b), (c, d) = RANGES[name]
        bin_ = 0 if v < c else 1 if v < a else 2 if v <= b else 3 if v <= d else 4
        x[feature(f"{name} {bin_}", BITS)] = 1.0
    return np.fromiter(x.keys(), np.int64, len(x)), np.fromiter(x.values(), float, len(x))


def fit(df: DataFrame, sample: int = 20_000) -> tuple[LabelModel, np.ndarray, float]:
    small_batches(df.sparkSession)

    def vote(batches):
        for b in batches:
            seen = Counter(bytes(v + 1 for v in votes(s)) for s in map(statistics, b.column(0).to_pylist()) if s["words"])
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    counted = df.select("text").mapInArrow(vote, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    if not counted:
        return LabelModel(), np.zeros(1 << BITS), 0.0
    patterns = np.array([list(r["votes"]) for r in counted], np.int64) - 1
    counts = np.array([r["n"] for r in counted], float)
    # One way to be bad for each labeller that says so, and good where none does.
    start = np.concatenate([patterns == 0, (patterns != 0).all(1)[:, None]], 1) + 1e-4
    model = LabelModel().fit(patterns, counts, start / start.sum(1, keepdims=True), false_alarms=0.005)
    share = min(1.0, sample / counts.sum())
    drawn = df.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")

    def learn(batches):
        rows, values, target = [], [], []
        # In an order of their own, so that reruns agree.
        for text in sorted(t or "" for b in batches for t in b.column(0).to_pylist()):
            s = statistics(text)
            if s["words"]:
                r, v = features(text, s)
                rows.append(r)
                values.append(v)
                target.append(votes(s))
        p = model.posterior(np.array(target, np.int64).reshape(-1, len(LABELLERS)))
        w, b = train_linear(rows, values, p, np.ones(len(p)), 1 << BITS, rounds=400, shrink=1e-6)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], ["w", "b"])

    # One task fits on the bounded sample, which all tasks of the scan draw; only the weights come back.
    got = drawn.repartition(1).mapInArrow(tidy(learn), "w binary, b double").first()
    return (model, np.frombuffer(got["w"]), got["b"]) if got else (model, np.zeros(1 << BITS), 0.0)


def quality_scores(df: DataFrame, sample: int = 20_000, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` with ``score`` (0 to 1, higher is better), ``posterior`` and ``keep``."""
    df = df.drop("score", "posterior", "keep")
    model, w, b = fit(df, sample)

    def score(batches):
        for batch in batches:
            scores, post, any_ = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                s = statistics(text)
                r, v = features(text, s)
                z = b + float(w[r] @ v)
                any_.append(s["words"] > 0)
                scores.append(1 / (1 + np.exp(-max(-50.0, min(50.0, z)))) if s["words"] else 0.0)
                post.append(votes(s))
            p = model.posterior(np.array(post, np.int64).reshape(-1, len(LABELLERS))) if any(any_) else np.zeros(len(post))
            keep = [s >= least for s in scores]
            names = [f"c{k}" for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(np.where(any_, p, 0.0), pa.float64()), pa.array(keep, pa.bool_())], [*names, "s", "p", "k"])

    names = df.columns
    inner = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(df.dtypes))
    out = df.mapInArrow(tidy(score), f"{inner}, s double, p double, k boolean")
    return out.toDF(*names, "score", "posterior", "keep")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, posterior, keep) of all documents."""
    return quality_scores(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "score", "posterior", "keep")
