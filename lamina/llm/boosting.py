"""Small numpy learners shared by the classifiers: bins, boosted additive tables, boosted trees, isotonic fits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def bin_edges(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Cut points of each feature at its quantiles; equal values never part."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, most + 1)[1:-1], method="higher")) if len(c) else np.empty(0) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="right") for c, e in zip(x.T, edges)], axis=1)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, ridge: float = 1.0) -> np.ndarray:
    """Value of each of a row of bins from the best splits of it into ``leaves`` runs, found greedily."""
    cuts = [0, len(g)]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def gain(a, b):
        return (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)

    while len(cuts) - 1 < leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                v = np.where((H[m] - H[a] >= least) & (H[b] - H[m] >= least), gain(a, m) + gain(m, b) - gain(a, b), 0)
                if v.max() > best[0]:
                    best = (v.max(), int(m[v.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -(G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


@dataclass
class AdditiveModel:
    """Lookup tables over bins of single features and of pairs; a score is the sum of one cell of each."""

    edges: list
    base: float
    tables: list
    coarse: list
    pairs: list

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6, grid: int = 8, least: float = 2.0) -> AdditiveModel:
        """Cyclic boosting: every round gives each feature in turn a shallow tree on the logistic gradient.

        Then pairs are ranked by how much a tree over their grid would gain on what is left, and the best
        ``n_pairs`` are boosted in turn in the same way, a split of one feature and one of the other a tree.
        """
        edges = bin_edges(x)
        b = binned(x, edges)
        sizes = [len(e) + 1 for e in edges]
        rate0 = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        base = float(np.log(rate0 / (1 - rate0)))
        tables = [np.zeros(n) for n in sizes]
        z = np.full(len(y), base)
        for _ in range(rounds if len(y) else 0):
            for f, n in enumerate(sizes):
                if n < 2:
                    continue
                p = sigmoid(z)
                g = np.bincount(b[:, f], p - y, n)
                h = np.bincount(b[:, f], p * (1 - p), n)
                step = rate * shallow_tree(g, h, leaves, least)
                tables[f] += step
                z += step[b[:, f]]
        coarse = [e[np.unique(np.linspace(0, len(e) - 1, min(len(e), grid - 1)).astype(int))] if len(e) else e for e in edges]
        c = binned(x, coarse)
        k = [len(e) + 1 for e in coarse]
        wide = [f for f in range(len(k)) if k[f] > 1]

        def grids(f, q):
            p = sigmoid(z)
            cell = c[:, f] * k[q] + c[:, q]
            return np.bincount(cell, p - y, k[f] * k[q]).reshape(k[f], k[q]), np.bincount(cell, p * (1 - p), k[f] * k[q]).reshape(k[f], k[q])

        def tree(g, h):
            """The best cut of the first feature, then of the second on either side."""
            best, value = -1.0, np.zeros_like(g)
            for m in range(1, len(g)):
                out, gain = np.zeros_like(g), 0.0
                for part in (slice(0, m), slice(m, None)):
                    row = shallow_tree(g[part].sum(0), h[part].sum(0), 2, least)
                    gain -= (row * g[part].sum(0)).sum()
                    out[part] = row
                if gain > best:
                    best, value = gain, out
            return best, value

        ranking = sorted(((-tree(*grids(f, q))[0], f, q) for i, f in enumerate(wide) for q in wide[i + 1 :]), key=lambda t: t)[:n_pairs] if len(y) else []
        pairs = [(f, q, np.zeros((k[f], k[q]))) for _, f, q in ranking]
        for _ in range(rounds // 3):
            for f, q, t in pairs:
                step = rate * tree(*grids(f, q))[1]
                t += step
                z += step[c[:, f], c[:, q]]
        return cls(edges, base, tables, coarse, pairs)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        if self.pairs:
            c = binned(x, self.coarse)
            for f, q, t in self.pairs:
                z += t[c[:, f], c[:, q]]
        return sigmoid(z)


@dataclass
class BoostedTrees:
    """Trees of one depth over binned features, grown level by level from histograms of the logistic gradient."""

    edges: list
    base: float
    trees: list

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.15, least: float = 2.0, ridge: float = 1.0) -> BoostedTrees:
        edges = bin_edges(x)
        b = binned(x, edges)
        n_bins = max([len(e) + 1 for e in edges], default=1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        base = float(np.log(mean / (1 - mean)))
        z, trees = np.full(len(y), base), []
        for _ in range(n_trees if len(y) else 0):
            p = sigmoid(z)
            g, h = p - y, p * (1 - p)
            node, levels = np.zeros(len(y), dtype=int), []
            for level in range(depth):
                m = 1 << level
                feature, cut, best = np.zeros(m, dtype=int), np.full(m, n_bins, dtype=int), np.full(m, 1e-9)
                for f in range(x.shape[1]):
                    cell = node * n_bins + b[:, f]
                    G = np.bincount(cell, g, m * n_bins).reshape(m, n_bins).cumsum(1)
                    H = np.bincount(cell, h, m * n_bins).reshape(m, n_bins).cumsum(1)
                    gt, ht = G[:, -1:], H[:, -1:]
                    v = G**2 / (H + ridge) + (gt - G) ** 2 / (ht - H + ridge) - gt**2 / (ht + ridge)
                    v[(H < least) | (ht - H < least)] = 0
                    i = v.argmax(1)
                    better = v[np.arange(m), i] > best
                    best[better], feature[better], cut[better] = v[np.arange(m), i][better], f, i[better]
                levels.append((feature, cut))
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
            trees.append((levels, leaf))
            z += leaf[node]
        return cls(edges, base, trees)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = binned(x, self.edges), np.arange(len(x))
        z = np.full(len(x), self.base)
        for levels, leaf in self.trees:
            node = np.zeros(len(x), dtype=int)
            for feature, cut in levels:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            z += leaf[node]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and the rising values between which scores are interpolated."""
    u, inverse = np.unique(z, return_inverse=True)
    value = np.bincount(inverse, y) / np.bincount(inverse)
    blocks: list[list[float]] = []
    for at, v, w in zip(u, value, np.bincount(inverse)):
        blocks.append([v, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, hi = blocks.pop()
            v1, w1, lo, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    knots = np.array([t for b in blocks for t in (b[2], b[3])])
    return knots, np.array([b[0] for b in blocks for _ in (0, 1)])
