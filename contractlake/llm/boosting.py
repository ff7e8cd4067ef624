"""Gradient-boosted trees over dense features with a logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete binary trees: `feature` and `limit` of the inner nodes, `leaf` values; a row goes right where its value exceeds the limit."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Trees on histograms of at most `bins` bins a feature; works on any number of rows above 0."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    prior = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    score = np.full(n, base)
    feature = np.zeros((rounds, (1 << depth) - 1), np.int32)
    limit = np.full((rounds, (1 << depth) - 1), np.inf)
    leaf = np.zeros((rounds, 1 << depth))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 1 << level
            best = np.full(nodes, 1e-6)
            g_all, h_all = np.bincount(node, grad, nodes), np.bincount(node, hess, nodes)
            for j in range(width):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                cell = node * k + binned[j]
                g = np.bincount(cell, grad, nodes * k).reshape(nodes, k).cumsum(axis=1)[:, :-1]
                h = np.bincount(cell, hess, nodes * k).reshape(nodes, k).cumsum(axis=1)[:, :-1]
                gain = g**2 / (h + ridge) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + ridge) - (g_all**2 / (h_all + ridge))[:, None]
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                for i in np.flatnonzero(top > best):
                    best[i] = top[i]
                    feature[t, nodes - 1 + i], limit[t, nodes - 1 + i] = j, edges[j][at[i]]
            own = nodes - 1 + node
            node = node * 2 + (x[np.arange(n), feature[t, own]] > limit[t, own])
        g_all, h_all = np.bincount(node, grad, 1 << depth), np.bincount(node, hess, 1 << depth)
        leaf[t] = rate * g_all / (h_all + ridge)
        score += leaf[t, node]
    return Trees(base, feature, limit, leaf)


def raw_scores(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Log-odds of each row."""
    rows = np.arange(len(x))
    score = np.full(len(x), trees.base)
    for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf, strict=True):
        at = np.zeros(len(x), np.int64)
        while at.size and at[0] < len(feature):
            at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
        score += leaf[at - len(feature)] if at.size else 0
    return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of the rising fit, read with linear interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean label, weight, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, s2 = blocks.pop()
            v1, w1, s1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, s1 + s2])
    # A block of few rows is pulled a little to the overall rate, so none says 0 or 1 for certain.
    rate = float(y.mean()) if len(y) else 0.0
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] * b[1] + rate) / (b[1] + 1) for b in blocks])
