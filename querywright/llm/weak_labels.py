"""A generative label model, fitted by expectation-maximisation, and a linear model on hashed features."""

from __future__ import annotations

import numpy as np
import xxhash

#: A vote: the class, or no opinion.
NONE = -1


class LabelModel:
    """Vote rates of overlapping labellers in each class, fitted by expectation-maximisation.

    The last class is the one whose probability is wanted; the classes before it are the parts of its
    opposite (one, or one for each way to be bad, since texts bad in one way look good to most
    labellers).  A labeller that abstains says nothing about the class.  Fitted on distinct vote
    patterns with their counts, so its cost does not grow with the rows.  Votes of labellers that
    agree beyond what the class explains can be discounted by their correlation."""

    def __init__(self, smooth: float = 0.5):
        self.smooth = smooth

    def _shares(self, votes: np.ndarray) -> np.ndarray:
        out = np.tile(np.log(self.prior), (len(votes), 1))
        for j in range(votes.shape[1]):
            says = np.concatenate([np.zeros((len(self.prior), 1)), np.log(self.rate[:, j])], 1)
            out += self.weight[j] * says[:, votes[:, j] + 1].T
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(last class) of each pattern."""
        return self._shares(votes)[:, -1] if len(votes) else np.zeros(0)

    def fit(self, votes: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 50, correlated: bool = False, false_alarms: float = 1.0) -> LabelModel:
        """``start``: a row of class probabilities for each pattern to begin with; ``false_alarms``: what share of
        the last class a labeller may speak against at most."""
        k, c = votes.shape[1], start.shape[1]
        self.weight = np.ones(k)
        self.rate = np.zeros((c, k, 2))
        p = start.astype(float)
        for _ in range(rounds):
            share = (p * counts[:, None]).T
            self.prior = (share.sum(1) + self.smooth) / (share.sum() + c * self.smooth)
            for j in range(k):
                for v in range(2):
                    self.rate[:, j, v] = share[:, votes[:, j] == v].sum(1) + self.smooth
            self.rate /= self.rate.sum(2, keepdims=True)
            self.rate[-1, :, 0] = np.minimum(self.rate[-1, :, 0], false_alarms)
            self.rate[-1, :, 1] = 1 - self.rate[-1, :, 0]
            if correlated:
                self.weight = self._discount(votes, share)
            new = self._shares(votes)
            if np.abs(new - p).max(initial=0) < 1e-6:
                break
            p = new
        return self

    def _discount(self, votes: np.ndarray, share: np.ndarray) -> np.ndarray:
        """1 / (1 + what the others repeat), from correlations of the votes within the classes."""
        x = (votes == 1).astype(float) - (votes == 0)
        total = np.zeros((x.shape[1], x.shape[1]))
        for c in range(len(share)):
            w = share[c] / max(share[c].sum(), 1e-9)
            d = x - w @ x
            cov = (d * w[:, None]).T @ d
            sd = np.sqrt(np.diag(cov))
            total += self.prior[c] * cov / np.maximum(np.outer(sd, sd), 1e-9)
        np.fill_diagonal(total, 0)
        return 1 / (1 + np.clip(total, 0, 1).sum(1))


def feature(name: str | bytes, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(name) & ((1 << bits) - 1)


def train_linear(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, weight: np.ndarray, dims: int, rounds: int = 60, rate: float = 0.5, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows with soft targets, full-batch Adagrad: the same each time."""
    w, b = np.zeros(dims), 0.0
    if not rows:
        return w, b
    sizes = np.array([len(r) for r in rows])
    at = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    x = np.concatenate(values) if sizes.sum() else np.zeros(0)
    row = np.repeat(np.arange(len(rows)), sizes)
    gw, gb, n = np.full(dims, 1e-8), 1e-8, weight.sum()
    for _ in range(rounds):
        z = b + np.bincount(row, w[at] * x, len(rows))
        d = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / n
        g = np.bincount(at, d[row] * x, dims) + shrink * w
        gw += g * g
        gb += d.sum() ** 2
        w -= rate * g / np.sqrt(gw)
        b -= rate * d.sum() / np.sqrt(gb)
    return w, float(b)
