"""Boosted models on a bounded matrix of features, fitted on the driver with numpy.

Both learners see features as bins.  ``fit_additive`` trains a generalised additive
model with pairwise interactions: shallow trees on one feature at a time, cyclically,
whose outputs add up to one lookup table per feature; then the same on the few pairs
that explain most of what is left.  ``fit_trees`` trains ordinary gradient-boosted
trees of fixed depth and calibrates them with isotonic regression.  Models are small
dictionaries of arrays, so a closure can carry them to the tasks that score.
"""

import numpy as np

MAX_BINS = 32


def bin_edges(x: np.ndarray, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cut points per feature: distinct quantiles, so equal values share a bin."""
    cuts = []
    for j in range(x.shape[1]):
        found = np.unique(x[:, j])
        if len(found) > bins:
            found = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        else:
            found = (found[1:] + found[:-1]) / 2
        cuts.append(found)
    return cuts


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.int64)
    for j, cuts in enumerate(edges):
        out[:, j] = np.searchsorted(cuts, x[:, j], side="right")
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _prior(y: np.ndarray) -> float:
    p = (y.sum() + 0.5) / (len(y) + 1)
    return float(np.log(p / (1 - p)))


def _leaf(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    return g / (h + smooth)


def _shallow_table(g: np.ndarray, h: np.ndarray, splits: int) -> np.ndarray:
    """The output per bin of a tree with up to ``splits`` splits along one ordered axis."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def score(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)

    for _ in range(splits):
        best = None
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = score(a, m) + score(m, b) - score(a, b)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = (float(gain[i]), k, int(m[i]))
        if best is None:
            break
        a, b = parts[best[1]]
        parts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, splits: int = 3,
                 pairs: int = 5, pair_bins: int = 8, pair_rounds: int = 20) -> dict:
    """Tables per feature and per chosen pair; see the module."""
    edges = bin_edges(x)
    b, n_bins = binned(x, edges), [len(e) + 1 for e in edges]
    tables = [np.zeros(n) for n in n_bins]
    z = np.full(len(y), _prior(y))
    for _ in range(rounds):
        for j, n in enumerate(n_bins):
            p = sigmoid(z)
            step = rate * _shallow_table(np.bincount(b[:, j], y - p, n), np.bincount(b[:, j], p * (1 - p), n), splits)
            tables[j] += step
            z += step[b[:, j]]
    coarse = [e[np.unique(np.linspace(0, len(e) - 1, min(len(e), pair_bins - 1)).astype(int))] if len(e) else e for e in edges]
    c, n_coarse = binned(x, coarse), [len(e) + 1 for e in coarse]
    # How much each pair's grid would take off the loss, over what its two margins do.
    p = sigmoid(z)
    g, h = y - p, p * (1 - p)

    def gain(cell, n):
        return float((np.bincount(cell, g, n) ** 2 / (np.bincount(cell, h, n) + 1.0)).sum())

    ranked = sorted(
        ((gain(c[:, i] * n_coarse[j] + c[:, j], n_coarse[i] * n_coarse[j])
          - gain(c[:, i], n_coarse[i]) - gain(c[:, j], n_coarse[j]), i, j)
         for i in range(x.shape[1]) for j in range(i)), reverse=True)
    grids = []
    for value, i, j in ranked[:pairs]:
        if value > 0:
            grids.append((i, j, np.zeros(n_coarse[i] * n_coarse[j])))
    for _ in range(pair_rounds):
        for i, j, grid in grids:
            p, cell = sigmoid(z), c[:, i] * n_coarse[j] + c[:, j]
            step = rate * _leaf(np.bincount(cell, y - p, len(grid)), np.bincount(cell, p * (1 - p), len(grid)), 5.0)
            grid += step
            z += step[cell]
    return {"bias": _prior(y), "edges": edges, "tables": tables, "coarse": coarse, "grids": grids}


def score_additive(model: dict, x: np.ndarray) -> np.ndarray:
    """One lookup and addition per feature and pair, for all rows at once."""
    b, c = binned(x, model["edges"]), binned(x, model["coarse"])
    z = np.full(len(x), model["bias"])
    for j, table in enumerate(model["tables"]):
        z += table[b[:, j]]
    for i, j, grid in model["grids"]:
        z += grid[c[:, i] * (len(model["coarse"][j]) + 1) + c[:, j]]
    return sigmoid(z)


def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, n_bins: list[int], least: float) -> tuple:
    """A complete binary tree, level by level: (feature, cut) per inner node, one value per leaf."""
    node = np.zeros(len(g), np.int64)
    features, cuts = [], []
    for level in range(depth):
        width = 2 ** level
        best = np.full(width, 1e-9)
        feature, cut = np.zeros(width, np.int64), np.full(width, 10 ** 6, np.int64)  # no gain: all go left
        for j, n in enumerate(n_bins):
            if n < 2:
                continue
            cell = node * n + b[:, j]
            cg = np.bincount(cell, g, width * n).reshape(width, n).cumsum(1)
            ch = np.bincount(cell, h, width * n).reshape(width, n).cumsum(1)
            gl, hl, gt, ht = cg[:, :-1], ch[:, :-1], cg[:, -1:], ch[:, -1:]
            value = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
            value[(hl < least) | (ht - hl < least)] = 0
            k = value.argmax(1)
            top = value[np.arange(width), k]
            better = top > best
            best[better], feature[better], cut[better] = top[better], j, k[better]
        features.append(feature)
        cuts.append(cut)
        node = 2 * node + (b[np.arange(len(g)), feature[node]] > cut[node])
    return features, cuts, _leaf(np.bincount(node, g, 2 ** depth), np.bincount(node, h, 2 ** depth))


def _drop_down(tree: tuple, b: np.ndarray) -> np.ndarray:
    features, cuts, leaves = tree
    node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for feature, cut in zip(features, cuts):
        node = 2 * node + (b[rows, feature[node]] > cut[node])
    return leaves[node]


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; a step function as (upper score of the step, share of positives)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, upper score
    for s, label in zip(score[order], y[order]):
        if blocks and blocks[-1][2] == s:
            blocks[-1][0] += label
            blocks[-1][1] += 1
        else:
            blocks.append([float(label), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, count, upper = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + count, upper]
    return np.array([x[2] for x in blocks]), np.array([(x[0] + 0.02) / (x[1] + 0.04) for x in blocks])


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 1.0) -> dict:
    """Boosted trees; every fourth row is held back from them and calibrates the scores."""
    edges = bin_edges(x)
    b, n_bins = binned(x, edges), [len(e) + 1 for e in edges]
    hold = np.arange(len(y)) % 4 == 3
    if len(y) < 40 or not 0 < y[hold].sum() < hold.sum():
        hold[:] = False
    bias = _prior(y[~hold])
    z, forest = np.full((~hold).sum(), bias), []
    for _ in range(trees):
        p = sigmoid(z)
        features, cuts, leaves = _grow(b[~hold], y[~hold] - p, p * (1 - p), depth, n_bins, least)
        forest.append((features, cuts, rate * leaves))
        z += _drop_down(forest[-1], b[~hold])
    model = {"bias": bias, "edges": edges, "forest": forest, "steps": None}
    if hold.any():
        model["steps"] = isotonic(_margin(model, b[hold]), y[hold])
    return model


def _margin(model: dict, b: np.ndarray) -> np.ndarray:
    z = np.full(len(b), model["bias"])
    for tree in model["forest"]:
        z += _drop_down(tree, b)
    return z


def score_trees(model: dict, x: np.ndarray) -> np.ndarray:
    """Calibrated scores; the uncalibrated one breaks ties within a step by a hair."""
    z = _margin(model, binned(x, model["edges"]))
    if model["steps"] is None:
        return sigmoid(z)
    upper, share = model["steps"]
    step = np.minimum(np.searchsorted(upper, z, side="left"), len(upper) - 1)
    return np.clip(share[step] + 1e-3 * (sigmoid(z) - 0.5), 0, 1)
