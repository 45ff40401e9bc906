"""Gradient-boosted regression trees on histograms, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, threshold, leaf values: complete trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 4.0, l2: float = 1.0) -> Boosted:
    """Logistic loss; y of 0 and 1.  Each tree is complete; a node without a gain sends all rows left."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, float(np.log(p / (1 - p))))
    f = np.full(len(y), model.start)
    inner, leaves = 2**depth - 1, 2**depth
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, None)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e) or len(rows) < 2 * least:
                    continue
                n = len(e) + 1
                c = codes[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, n))[:-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, e[k])
            if best[2] is not None:
                feature[node], threshold[node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        model.trees.append((feature, threshold, value))
        f += value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray, smooth: float = 0.5, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; points for linear interpolation.  Each block is drawn to the weighted mean by ``smooth`` rows of mean weight."""
    order = np.argsort(score, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    base, smooth = float(np.average(y, weights=weight)), smooth * float(weight.mean())
    blocks: list[list[float]] = []  # sum, weight, first, last
    for s, v, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([float(v * w), float(w), float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    xs, ys = [], []
    for total, n, lo, hi in blocks:
        v = (total + smooth * base) / (n + smooth)
        xs += [lo, hi] if hi > lo else [lo]
        ys += [v, v] if hi > lo else [v]
    return np.array(xs), np.maximum.accumulate(np.array(ys))
