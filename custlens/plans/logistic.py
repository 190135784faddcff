"""L2 logistic regression of the full training set and of all folds in one optimiser.

A pass gives loss, gradient and Hessian of every unfinished fit (each its own rows by a fold mask, its
own scaling), so all fits together take the passes of the slowest one: Newton's method with step
halving.  The objective is |w|^2 / (2 C) + sum of log-losses on inputs scaled by the population
deviation, the intercept free: the settings of the reference's model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from custlens.plans.blocks import block_count, reduced
from custlens.plans.fitted import LogisticModel

MOST_PASSES = 100


def kept(fold: np.ndarray, left_out: int | None) -> np.ndarray:
    """Rows of a fit: all, or those outside one fold."""
    return np.ones(len(fold), dtype=bool) if left_out is None else fold != left_out


def _scaling(blocks: DataFrame, n_blocks: int, width: int, folds: list[int | None]):
    def moments(ids, x, extra):
        return np.concatenate([np.concatenate(([m.sum()], [extra[m, 0].sum()], x[m].sum(axis=0))) for m in (kept(extra[:, 1], f) for f in folds)])

    v = reduced(blocks, moments, n_blocks).reshape(len(folds), 2 + width)
    n = np.maximum(v[:, :1], 1.0)
    mean = v[:, 2:] / n

    def squares(ids, x, extra):
        return np.concatenate([((x[m] - mean[i]) ** 2).sum(axis=0) for i, m in enumerate(kept(extra[:, 1], f) for f in folds)])

    std = np.sqrt(reduced(blocks, squares, n_blocks).reshape(len(folds), width) / n)
    return v[:, 0], v[:, 1], mean, np.where(std > 0, std, 1.0)


def fit_all(blocks: DataFrame, features: list[str], folds: list[int | None], c: float = 1.0, tol: float = 1e-9) -> list[LogisticModel]:
    """One model per entry of ``folds`` (None: all rows; f: rows outside fold f).  ``blocks`` has the
    features and, as extra columns, label and fold."""
    blocks = blocks.persist()   # read by every pass; recomputable from its table
    width, n_blocks = len(features), block_count(blocks)
    n, ones, mean, std = _scaling(blocks, n_blocks, width, folds)
    d = width + 1
    theta, best = np.zeros((len(folds), d)), np.full(len(folds), np.inf)
    step, grad = np.zeros((len(folds), d)), np.zeros((len(folds), d))
    open_ = [i for i in range(len(folds)) if 0 < ones[i] < n[i]]
    for i in set(range(len(folds))) - set(open_):   # one class (or no rows): a constant
        theta[i, -1] = 20.0 if ones[i] else -20.0
    for _ in range(MOST_PASSES):
        if not open_:
            break
        at = theta + step

        def sums(ids, x, extra, at=at, open_=list(open_)):
            out = []
            for i in open_:
                m = kept(extra[:, 1], folds[i])
                z = np.concatenate(((x[m] - mean[i]) / std[i], np.ones((m.sum(), 1))), axis=1)
                y, margin = extra[m, 0], z @ at[i]
                p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
                loss = (np.logaddexp(0.0, margin) - y * margin).sum()
                out += [[loss], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]
            return np.concatenate(out)

        v = reduced(blocks, sums, n_blocks).reshape(len(open_), 1 + d + d * d)
        still = []
        for i, row in zip(open_, v):
            w = np.append(at[i, :-1], 0.0)
            loss = row[0] + w @ w / (2 * c)
            if loss > best[i] + 1e-12 * abs(best[i]) and np.abs(step[i]).max() > 1e-10:
                step[i] /= 2                      # too far: half of the step
                still.append(i)
                continue
            theta[i], best[i] = at[i], loss
            grad[i] = row[1:1 + d] + w / c
            hessian = row[1 + d:].reshape(d, d) + np.diag(np.append(np.full(width, 1 / c), 1e-12))
            step[i] = -np.linalg.solve(hessian, grad[i])
            if np.abs(grad[i]).max() > tol * max(1.0, n[i]):
                still.append(i)
            else:
                step[i] = 0.0
        open_ = still
    blocks.unpersist()
    return [LogisticModel(features, mean[i].tolist(), std[i].tolist(), theta[i, :-1].tolist(), float(theta[i, -1])) for i in range(len(folds))]
