"""K-Means for all numbers of clusters and all starts at once (H2, H3).

Every pass over the blocked table serves all models: seeding draws one centre of each start (by
exponential keys over squared distances, so the row with the smallest key is a draw in proportion to
them), a Lloyd pass assigns each row to the centres of every unfinished model and sums rows per
cluster.  So a search takes as many passes as its slowest model has iterations, whatever the number
of models.  Models are a few centres; nothing else reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from custlens.plans.blocks import block_count, reduced


@dataclass
class KMeansFit:
    k: int
    seed: int
    centres: np.ndarray
    inertia: float
    iterations: int


def _uniform(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1) per row, the same wherever the row lies."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + step + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(d, 0.0)


def seeded(blocks: DataFrame, n_blocks: int, width: int, k: int, seeds: list[int]) -> np.ndarray:
    """k-means++ centres of every seed, (seed, k, width)."""
    chosen = np.zeros((len(seeds), 0, width))
    for step in range(k):
        def draw(ids, x, extra, chosen=chosen, step=step):
            out = np.full((len(seeds), 1 + width), np.inf)
            for i, seed in enumerate(seeds):
                gap = _distances(x, chosen[i]).min(axis=1) if step else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    key = np.where(gap > 1e-12, -np.log(_uniform(ids, seed, step)) / gap, np.inf)
                at = int(np.argmin(key))
                out[i, 0], out[i, 1:] = key[at], x[at]   # all rows are centres: any will do
            return out.ravel()

        def nearer(a, b):
            a, b = a.reshape(-1, 1 + width), b.reshape(-1, 1 + width)
            return np.where(a[:, :1] <= b[:, :1], a, b).ravel()

        drawn = reduced(blocks, draw, n_blocks, nearer).reshape(len(seeds), 1 + width)[:, None, 1:]
        chosen = np.concatenate((chosen, drawn), axis=1)
    return chosen


def _cluster_sums(centres: list[np.ndarray]):
    """Per model and cluster: rows, sum of rows; then the model's cost."""
    def sums(ids, x, extra):
        out, columns, length = [], np.ascontiguousarray(x.T), (x * x).sum(axis=1)
        for c in centres:
            # one centre at a time over all rows: distances less the row's own length
            near, least = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
            for i, (at, own) in enumerate(zip(-2 * c, (c * c).sum(axis=1))):
                d = at @ columns + own
                closer = d < least   # ties go to the first centre
                near[closer] = i
                np.minimum(least, d, out=least)
            out += [np.bincount(near, minlength=len(c)), np.stack([np.bincount(near, v, len(c)) for v in columns], axis=1).ravel(), [np.maximum(least + length, 0.0).sum()]]
        return np.concatenate(out)
    return sums


def _split(v: np.ndarray, ks: list[int], width: int):
    at = 0
    for k in ks:
        n, s = v[at:at + k], v[at + k:at + k + k * width].reshape(k, width)
        yield n, s, float(v[at + k + k * width])
        at += k + k * width + 1


def fit_all(blocks: DataFrame, width: int, ks: list[int], seeds: list[int], max_iter: int = 300, tol: float = 1e-4) -> list[KMeansFit]:
    """Every (k, seed); ``blocks`` are of ``blocks.pack``.  A cluster that loses all rows keeps its centre."""
    blocks = blocks.persist()   # read by every pass; recomputable from its table
    n_blocks = block_count(blocks)
    start = seeded(blocks, n_blocks, width, max(ks), seeds)
    jobs = [(k, s) for k in ks for s in range(len(seeds))]
    centres = [start[s][:k].copy() for k, s in jobs]
    iterations, open_ = [0] * len(jobs), list(range(len(jobs)))
    for _ in range(max_iter):
        if not open_:
            break
        v = reduced(blocks, _cluster_sums([centres[j] for j in open_]), n_blocks)
        still = []
        for j, (n, s, _) in zip(open_, _split(v, [jobs[j][0] for j in open_], width)):
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1.0)[:, None], centres[j])
            moved = ((new - centres[j]) ** 2).sum(axis=1).max()
            centres[j] = new
            iterations[j] += 1
            if moved > tol * tol:
                still.append(j)
        open_ = still
    v = reduced(blocks, _cluster_sums(centres), n_blocks)
    costs = [cost for _, _, cost in _split(v, [k for k, _ in jobs], width)]
    blocks.unpersist()
    return [KMeansFit(k, seeds[s], centres[j], costs[j], iterations[j]) for j, (k, s) in enumerate(jobs)]


def best_of(fits: list[KMeansFit]) -> KMeansFit:
    return min(fits, key=lambda f: (f.inertia, f.seed))   # lowest cost; ties go to the first start


def squared_silhouettes(blocks: DataFrame, width: int, fits: list[KMeansFit]) -> list[float]:
    """Mean silhouette with squared distances of every model, exact, from per-cluster sums: two passes.

    The mean squared distance of a row x to a cluster with n rows, sum S and squares Q is
    |x|^2 + Q/n - 2 x.S/n; a row alone in its cluster, or a single cluster, gives 0."""
    n_blocks = block_count(blocks)
    ks, centres = [f.k for f in fits], [f.centres for f in fits]

    def squares(ids, x, extra):
        out = []
        for c in centres:
            near = _distances(x, c).argmin(axis=1)
            out.append(np.bincount(near, weights=(x * x).sum(axis=1), minlength=len(c)))
        return np.concatenate(out)

    sums = [(n, s) for n, s, _ in _split(reduced(blocks, _cluster_sums(centres), n_blocks), ks, width)]
    q = np.split(reduced(blocks, squares, n_blocks), np.cumsum(ks)[:-1])

    def total(ids, x, extra):
        out = []
        for c, (n, s), sq in zip(centres, sums, q):
            near = _distances(x, c).argmin(axis=1)
            size = np.maximum(n, 1.0)
            d = np.maximum((x * x).sum(axis=1)[:, None] + sq / size - 2 * x @ (s / size[:, None]).T, 0.0)
            d[:, n == 0] = np.inf
            rows = np.arange(len(x))
            own = d[rows, near] * n[near] / np.maximum(n[near] - 1, 1.0)
            d[rows, near] = np.inf
            other = d.min(axis=1)
            top = np.maximum(own, other)
            with np.errstate(invalid="ignore"):
                value = np.where((n[near] > 1) & np.isfinite(other) & (top > 0), (other - own) / top, 0.0)
            out.append([np.nan_to_num(value).sum(), len(x)])
        return np.array(out).ravel()

    v = reduced(blocks, total, n_blocks).reshape(-1, 2)
    return [float(a / n) for a, n in v]
