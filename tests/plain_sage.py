"""Graph convolution over a graph in memory, in plain numpy, to hold the blocks against."""

from __future__ import annotations

import numpy as np


class SageTrainer:
    """Full-batch Adam for two mean-aggregating layers over a bounded graph; rows of edges and pairs in parts of PART."""

    PART = 200_000

    def __init__(self, n: int, edges: np.ndarray, weight: np.ndarray, train: np.ndarray, dim: int, hidden: int, lr: float, negatives: int, dropout: float, seed: int):
        self.rng = np.random.default_rng(seed)
        self.n, self.lr, self.negatives, self.dropout = n, lr, negatives, dropout
        self.src = np.concatenate((edges[:, 0], edges[:, 1]))
        self.dst = np.concatenate((edges[:, 1], edges[:, 0]))
        self.deg = np.maximum(1, np.bincount(self.src, minlength=n))[:, None]
        self.pos = edges[train] if train.any() else edges
        w = weight[train] if train.any() else weight
        self.weight = w / w.mean()
        xavier = lambda *s: self.rng.uniform(-1, 1, s) * np.sqrt(6 / sum(s))
        self.params = [xavier(n, dim), xavier(dim, hidden), xavier(dim, hidden), np.zeros(hidden), xavier(hidden, dim), xavier(hidden, dim), np.zeros(dim)]
        self.m, self.v, self.t = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0
        self.losses: list[float] = []

    @property
    def x(self) -> np.ndarray:
        return self.params[0]

    def layers(self):
        p = self.params
        return (p[1], p[2], p[3]), (p[4], p[5], p[6])

    def gather(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]))
        for lo in range(0, len(self.src), self.PART):
            np.add.at(out, self.src[lo : lo + self.PART], x[self.dst[lo : lo + self.PART]])
        return out / self.deg

    def scatter(self, g: np.ndarray) -> np.ndarray:
        out, g = np.zeros((self.n, g.shape[1])), g / self.deg
        for lo in range(0, len(self.src), self.PART):
            np.add.at(out, self.dst[lo : lo + self.PART], g[self.src[lo : lo + self.PART]])
        return out

    def step(self, neg: np.ndarray | None = None) -> float:
        x, a1, b1, c1, a2, b2, c2 = self.params
        m1 = self.gather(x)
        h = x @ a1 + m1 @ b1 + c1
        keep = (self.rng.random(h.shape) >= self.dropout) / (1 - self.dropout)
        act = np.maximum(h, 0) * keep
        m2 = self.gather(act)
        z = act @ a2 + m2 @ b2 + c2
        neg = self.rng.integers(0, self.n, (len(self.pos) * self.negatives, 2)) if neg is None else neg
        loss, gz = 0.0, np.zeros_like(z)
        for pairs, y, weight in ((self.pos, 1, self.weight / len(self.pos)), (neg, 0, np.broadcast_to(1 / max(1, len(neg)), len(neg)))):
            for lo in range(0, len(pairs), self.PART):
                a, b, w = pairs[lo : lo + self.PART, 0], pairs[lo : lo + self.PART, 1], weight[lo : lo + self.PART]
                logit = (z[a] * z[b]).sum(1)
                loss += float((w * (np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit))))).sum())
                g = (w * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y))[:, None]
                np.add.at(gz, a, g * z[b])
                np.add.at(gz, b, g * z[a])
        gact = gz @ a2.T + self.scatter(gz @ b2.T)
        gh = gact * keep * (h > 0)
        grads = [gh @ a1.T + self.scatter(gh @ b1.T), x.T @ gh, m1.T @ gh, gh.sum(0), act.T @ gz, m2.T @ gz, gz.sum(0)]
        self.t += 1
        for i, d in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * d
            self.v[i] = 0.999 * self.v[i] + 0.001 * d * d
            self.params[i] = self.params[i] - self.lr * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)
        self.losses.append(loss)
        return loss
