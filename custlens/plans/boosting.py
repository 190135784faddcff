"""Histogram boosting of several fits at once.

Features are binned once (at most ``BINS`` quantile bins).  Per tree level one pass sums gradient,
Hessian and rows by (fit, node, feature, bin): the full fit and the folds of both boosted models are
masks over one table.  Each task adds up its blocks; the sums are shuffled by fit, and a fit's splits are
chosen where its sums meet, so that the driver gets a few numbers a node.  A round of all fits is at most as
many jobs as the deepest tree has levels; they are jobs of RDDs, as planning a query for each took longer than its
work.  Rows' margins travel with the blocks and are updated in the next round's first pass; every ``CUT_EVERY``
rounds they are checkpointed, and the trees so far are handed to ``progress``, from which a later session goes on.

``second_order``: gain G^2 / (H + lambda), leaves -G / (H + lambda), a child needs a Hessian of
``LEAST_HESSIAN``.  Otherwise trees are grown on the residuals by the gain of their squared error
and leaves take one Newton step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from custlens.plans.blocks import block_count, reduced, unpacked
from custlens.plans.fitted import BoostedModel, binned, leaf_of, margins
from custlens.plans.logistic import kept
from custlens.session import delete, delete_at_exit, ensure_checkpoint_dir

BINS = 128
CUT_EVERY = 5
PART_BLOCKS = 64   # that a task goes through in a pass, at most
LAMBDA = 1.0
LEAST_HESSIAN = 1.0
_BLOCK = "n int, bins binary, extra binary, margins binary"


@dataclass(frozen=True)
class Spec:
    """One fit: its trees' depth, kind, and the fold it leaves out (None: none)."""

    depth: int
    second_order: bool
    fold: int | None = None


def bin_edges(frame: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Ascending cuts per feature: quantiles of the training rows, the largest value left out."""
    found = frame.approxQuantile(features, [i / bins for i in range(1, bins)] + [1.0], 0.25 / bins)
    return [sorted({float(v) for v in q if v < q[-1]}) if q else [] for q in found]


def _states(blocks: DataFrame, n_blocks: int, edges, starts, trees_of) -> RDD:
    """Of every block: bins by row, label and fold, and every fit's margins; about as many blocks in each part."""
    def rows(batches):
        for ids, x, extra in unpacked(batches):
            b = binned(x, edges)
            yield _packed(b, extra[:, :2].T, np.stack([margins(b, s, t) for s, t in zip(starts, trees_of)]))

    cores = blocks.sparkSession.sparkContext.defaultParallelism
    n_parts = cores * max(1, -(-n_blocks // (cores * PART_BLOCKS)))
    return blocks.repartition(min(n_blocks, n_parts)).mapInArrow(rows, _BLOCK).rdd.map(_unpacked)


def _packed(bins, extra, margin) -> pa.RecordBatch:
    cols = [[np.ascontiguousarray(v).tobytes()] for v in (bins.astype(np.uint8), extra.astype(np.float64), margin.astype(np.float64))]
    return pa.RecordBatch.from_arrays([pa.array([len(bins)], pa.int32())] + [pa.array(c, pa.binary()) for c in cols], names=["n", "bins", "extra", "margins"])


def _unpacked(r):
    n = r["n"]
    return np.frombuffer(r["bins"], dtype=np.uint8).reshape(n, -1), np.frombuffer(r["extra"]).reshape(2, n), np.frombuffer(r["margins"]).reshape(-1, n)


def _updated(state: RDD, trees: list[dict], depths: list[int]) -> RDD:
    def update(block):
        bins, extra, margin = block
        out = margin.copy()
        for i, (t, depth) in enumerate(zip(trees, depths)):
            out[i] += np.asarray(t["value"])[leaf_of(bins, np.asarray(t["feature"]), np.asarray(t["cut"]), depth)]
        return bins, extra, out
    return state.map(update)


class _Tree:
    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature, self.cut, self.value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        self.open = [0]

    def as_dict(self):
        return {"feature": self.feature.tolist(), "cut": self.cut.tolist(), "value": self.value.tolist()}


def _sections(second_order: bool) -> int:
    """Sums a bin: gradient, Hessian, and rows where splits ask for them (a child's least Hessian implies rows)."""
    return 2 if second_order else 3


def _histograms(specs, trees, level, widths):
    """Of a block: sums of (gradient, Hessian, rows) by open node and feature's bin, one vector per fit with open
    nodes; and these fits with their numbers of open nodes."""
    parts = [(i, s, t.feature.copy(), t.cut.copy(), list(t.open)) for i, (s, t) in enumerate(zip(specs, trees)) if t.open]

    def of_fold(bins, extra, fold):   # rows outside the fold: which ones, their bins by row and by column, and labels
        if fold is None:
            return None, bins, bins.T.astype(np.int64), extra[0]
        at = np.flatnonzero(kept(extra[1], fold))
        mine = bins.take(at, axis=0)
        return at, mine, mine.T.astype(np.int64), extra[0].take(at)

    def sums(bins, extra, margin):
        by_fold = {}   # fits that leave out the same fold share its rows
        for i, spec, feature, cut, open_ in parts:
            if spec.fold not in by_fold:
                by_fold[spec.fold] = of_fold(bins, extra, spec.fold)
            rows, mine, columns, label = by_fold[spec.fold]
            local = np.full(len(feature), -1)
            local[open_] = np.arange(len(open_))
            node, m = local.take(leaf_of(mine, feature, cut, level)), margin[i] if rows is None else margin[i].take(rows)
            if node.size and node.min() < 0:   # some rows lie in leaves
                at = np.flatnonzero(node >= 0)
                node, m, label, columns = node.take(at), m.take(at), label.take(at), columns.take(at, axis=1)
            p = 1.0 / (1.0 + np.exp(-m))
            g, h = p - label, p * (1 - p)
            out, starts = [], {}
            for column, width in zip(columns, widths):
                if width not in starts:
                    starts[width] = node * width
                key, size = starts[width] + column, len(open_) * width
                out += [np.bincount(key, g, size), np.bincount(key, h, size)]
                if _sections(spec.second_order) == 3:
                    out.append(np.bincount(key, minlength=size).astype(np.float64))
            yield np.concatenate(out)

    return sums, [(i, len(open_)) for i, _, _, _, open_ in parts]


_CHOICE = 9   # gain, feature, cut, left sums, all sums


def _choices(v: np.ndarray, n_open: int, widths: list[int], second_order: bool) -> np.ndarray:
    """The best split of every open node of a fit from its sums over all rows."""
    hist, at, n = np.zeros((n_open, len(widths), 3, max(widths))), 0, _sections(second_order)
    for j, width in enumerate(widths):
        size = n * n_open * width
        hist[:, j, :n, :width] = v[at:at + size].reshape(n, n_open, width).transpose(1, 0, 2)
        at += size
    out = np.empty((n_open, _CHOICE))
    for local in range(n_open):
        gain, f, b, left, all_ = _best(hist[local], second_order)
        out[local] = [gain, f, b, *left, *all_]
    return out


def _splits(state: RDD, specs: list[Spec], trees: list[_Tree], level: int, widths: list[int]) -> dict[int, np.ndarray]:
    """One pass: the best split of every open node, by fit."""
    sums, sizes = _histograms(specs, trees, level, widths)
    if not sizes:
        return {}
    n_open, second = dict(sizes), [s.second_order for s in specs]
    n_parts, cores = state.getNumPartitions(), state.context.defaultParallelism

    def of_blocks(part, blocks):
        total = None
        for block in blocks:
            total = list(sums(*block)) if total is None else [np.add(t, v, out=t) for t, v in zip(total, sums(*block))]
        for (i, _), v in zip(sizes, total or []):
            yield i, (part, v)

    def of_sums(rows):   # a part's sums of a few fits
        by_fit = {}
        for i, (part, v) in rows:
            by_fit.setdefault(i, {})[part] = v
        for i, parts in sorted(by_fit.items()):
            total = np.zeros_like(next(iter(parts.values())))
            for part in sorted(parts):   # in the order of the parts, so that equal tables give equal sums
                total += parts[part]
            yield i, _choices(total, n_open[i], widths, second[i])

    found = state.mapPartitionsWithIndex(of_blocks)
    if n_parts > 1:   # otherwise its sums are those of all rows
        written = n_parts * sum(n_open.values()) * 3 * sum(widths) * 8   # bytes, about
        place = {i: at for at, i in enumerate(n_open)}
        found = found.partitionBy(max(1, min(len(sizes), cores, written // _SUMMED)), place.get)
    return dict(found.mapPartitions(of_sums).collect())   # a few numbers a node


_SUMMED = 4 * 2**20   # bytes of sums that are worth a task


def _best(hist: np.ndarray, second_order: bool):
    """(gain, feature, cut, left sums, all sums) of a node; ``hist`` is (feature, 3, bin)."""
    left = hist.cumsum(axis=2)[:, :, :-1]
    all_ = hist[0].sum(axis=1)
    right = all_[None, :, None] - left
    gl, hl, nl = left[:, 0], left[:, 1], left[:, 2]
    gr, hr, nr = right[:, 0], right[:, 1], right[:, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        if second_order:
            gain = gl**2 / (hl + LAMBDA) + gr**2 / (hr + LAMBDA) - all_[0] ** 2 / (all_[1] + LAMBDA)
            ok = (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN)   # so there are rows on both sides
        else:
            gain = nl * nr / all_[2] * (gl / nl - gr / nr) ** 2
            ok = (nl > 0) & (nr > 0)
    gain = np.where(ok, gain, -np.inf)
    at = int(np.argmax(gain))   # ties go to the first feature and bin
    f, b = divmod(at, gain.shape[1])
    return float(gain[f, b]), f, b, left[f, :, b], all_


def _leaf(sums: np.ndarray, second_order: bool, rate: float) -> float:
    bottom = sums[1] + (LAMBDA if second_order else 0.0)
    return float(-sums[0] / bottom * rate) if bottom > 1e-150 else 0.0


def fit_all(blocks: DataFrame, frame: DataFrame, features: list[str], specs: list[Spec], rounds: int = 100, rate: float = 0.1,
            done: dict | None = None, progress: Callable[[dict], None] | None = None) -> list[BoostedModel]:
    """One model per spec.  ``blocks`` has the features, label and fold; ``frame`` is the training table
    that bins are taken from; ``done`` is what ``progress`` was given last."""
    n_blocks, width = block_count(blocks), len(features)
    if done is None:
        def classes(ids, x, extra):
            return np.array([[m.sum(), extra[m, 0].sum()] for m in (kept(extra[:, 1], s.fold) for s in specs)]).ravel()

        n = reduced(blocks, classes, n_blocks).reshape(-1, 2)
        share = np.clip(n[:, 1] / np.maximum(n[:, 0], 1), 1e-6, 1 - 1e-6)
        done = {"edges": bin_edges(frame, features), "starts": np.log(share / (1 - share)).tolist(),
                "trees": [[] for _ in specs], "gains": [[0.0] * width for _ in specs]}
    edges, starts, grown, gains = done["edges"], done["starts"], done["trees"], done["gains"]
    widths = [len(e) + 1 for e in edges]
    depths = [s.depth for s in specs]
    spark = blocks.sparkSession
    ensure_checkpoint_dir(spark)
    state = _states(blocks, n_blocks, edges, starts, grown).persist(StorageLevel.MEMORY_AND_DISK)
    written, older = None, None
    for turn in range(len(grown[0]), rounds):
        trees = [_Tree(s.depth) for s in specs]
        for level in range(max(depths)):
            for t, s in zip(trees, specs):
                if level >= s.depth:
                    t.open = []
            chosen = _splits(state, specs, trees, level, widths)
            if older:   # the new margins are there
                older.unpersist()
                older = None
            if not chosen:
                break
            for i, splits in chosen.items():
                t, second, below = trees[i], specs[i].second_order, []
                for node, (gain, f, b, *rest) in zip(t.open, splits):
                    left, all_ = np.array(rest[:3]), np.array(rest[3:])
                    if level == 0:
                        t.value[0] = _leaf(all_, second, rate)
                    if gain > 1e-12:
                        t.feature[node], t.cut[node] = f, b
                        gains[i][int(f)] += float(gain)
                        t.value[2 * node + 1], t.value[2 * node + 2] = (_leaf(x, second, rate) for x in (left, all_ - left))
                        below += [2 * node + 1, 2 * node + 2]
                t.open = below
        for g, t in zip(grown, trees):
            g.append(t.as_dict())
        if turn + 1 == rounds:
            break
        older, state = state, _updated(state, [t.as_dict() for t in trees], depths).persist(StorageLevel.MEMORY_AND_DISK)
        if (turn + 1) % CUT_EVERY == 0:   # ends the chain of states; the trees so far are kept
            state.checkpoint()
            state.count()
            if written:
                delete(spark, written)
            written = delete_at_exit(spark, state.getCheckpointFile())
            if progress:
                progress(done)
    for d in (state, older):
        if d:
            d.unpersist()
    if written:
        delete(spark, written)
    return [BoostedModel(features, edges, starts[i], grown[i], gains[i]) for i in range(len(specs))]
