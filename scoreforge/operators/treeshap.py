"""Exact path-dependent Tree SHAP for Spark's tree ensembles.

A leaf whose path splits on the unique features P (|P| = m <= depth)
contributes to feature i of row x

    phi_i = v * (o_i - z_i) * sum_{S in P-{i}} |S|!(m-|S|-1)!/m! * prod_{S} o_j * prod_{rest} z_j

with o_j = 1 if x follows every split on j along the path, and z_j the
product of the child/parent cover ratios of those splits (Lundberg et al.,
path-dependent Tree SHAP, restated per leaf).  The sum is read off the
polynomial prod_{j != i} (z_j + o_j t): the product over all features is built once
and divided by one factor at a time, O(m^2) per leaf and distinct row
pattern.  The driver ships only the node table; paths and sums are made in the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    id: int
    prediction: float
    count: float
    left: int
    right: int
    feature: int
    threshold: float


@dataclass
class LeafPath:
    features: np.ndarray      # (m,) feature indices
    thresholds: list          # per feature: list of (threshold, go_left)
    cover: np.ndarray         # (m,) z_j
    value: float              # leaf prediction times tree weight


def leaf_paths(nodes: dict[int, Node], root: int, weight: float) -> tuple[list[LeafPath], float]:
    """The paths of a tree's leaves and its cover-weighted expected value (times weight); linear in the nodes."""
    out: list[LeafPath] = []
    expected = 0.0
    stack: list[tuple[int, list]] = [(root, [])]
    while stack:
        nid, path = stack.pop()
        n = nodes[nid]
        if n.left < 0:
            feats: dict[int, list] = {}
            zs: dict[int, float] = {}
            for f, thr, left, ratio in path:               # splits on one feature count once
                feats.setdefault(f, []).append((thr, left))
                zs[f] = zs.get(f, 1.0) * ratio
            fs = sorted(feats)
            z = np.array([zs[f] for f in fs])
            v = n.prediction * weight
            expected += v * float(np.prod(z))
            if fs:
                out.append(LeafPath(np.array(fs, dtype=np.int64), [feats[f] for f in fs], z, v))
            continue
        parent = n.count if n.count > 0 else 1.0
        for child, left in ((n.left, True), (n.right, False)):
            stack.append((child, path + [(n.feature, n.threshold, left, nodes[child].count / parent)]))
    return out, expected


def _leaf_values(o: np.ndarray, z: np.ndarray, value: float) -> np.ndarray:
    """(patterns, m) contributions for patterns ``o`` of followed features."""
    n, m = o.shape
    w = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
    poly = np.zeros((n, m + 1))
    poly[:, 0] = 1.0
    for j in range(m):                                     # times (z_j + o_j t)
        poly[:, 1:] = poly[:, 1:] * z[j] + poly[:, :-1] * o[:, j:j + 1]
        poly[:, 0] *= z[j]
    phi = np.zeros((n, m))
    for i in range(m):                                     # divided by (z_i + o_i t) again
        rest = np.zeros((n, m))
        rest[:, m - 1] = poly[:, m]
        for k in range(m - 1, 0, -1):
            rest[:, k - 1] = poly[:, k] - z[i] * rest[:, k]
        if z[i] > 0:
            off = o[:, i] == 0
            rest[off] = poly[off, :m] / z[i]
        phi[:, i] = value * (o[:, i] - z[i]) * (rest @ w)
    return phi


def contributions(x: np.ndarray, paths: list[LeafPath], n_features: int) -> np.ndarray:
    """(n, n_features) Shapley values for a batch of rows."""
    phi = np.zeros((x.shape[0], n_features))
    for p in paths:
        pattern = np.zeros(x.shape[0], dtype=np.int64)
        for k, f in enumerate(p.features):
            col = x[:, f]
            ok = np.ones(x.shape[0], dtype=bool)
            for thr, left in p.thresholds[k]:
                ok &= (col <= thr) if left else ~(col <= thr)
            pattern |= ok.astype(np.int64) << k
        seen, where = np.unique(pattern, return_inverse=True)
        o = (seen[:, None] >> np.arange(len(p.features)) & 1).astype(float)
        phi[:, p.features] += _leaf_values(o, p.cover, p.value)[where]
    return phi


def brute_force(x: np.ndarray, nodes: dict[int, Node], root: int, n_features: int) -> np.ndarray:
    """Exhaustive Shapley values of the cover-weighted conditional expectation
    game, for tests on tiny trees."""
    def value(s: set) -> float:
        def go(nid):
            n = nodes[nid]
            if n.left < 0:
                return n.prediction
            if n.feature in s:
                return go(n.left if x[n.feature] <= n.threshold else n.right)
            c = n.count if n.count > 0 else 1.0
            return (nodes[n.left].count * go(n.left) + nodes[n.right].count * go(n.right)) / c
        return go(root)

    phi = np.zeros(n_features)
    feats = list(range(n_features))
    m = n_features
    for i in feats:
        others = [f for f in feats if f != i]
        for r in range(len(others) + 1):
            from itertools import combinations
            for s in combinations(others, r):
                w = math.factorial(r) * math.factorial(m - r - 1) / math.factorial(m)
                phi[i] += w * (value(set(s) | {i}) - value(set(s)))
    return phi
