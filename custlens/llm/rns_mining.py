"""Operator 13: hard negatives by a residue-number-system matrix product.

Scores of anchors against all rows are exact integer inner products.  Components become
integers; a block of anchors and a block of rows are multiplied modulo several small primes in
float32 (symmetric residues, so that every partial sum stays below 2^24 and is exact), and the
signed scores are put together by Chinese remaindering in balanced mixed-radix digits.  As many
primes are taken as the largest possible score calls for (Cauchy-Schwarz on the largest norm).

Rows go to blocks of about ``BLOCK_COMPONENTS`` components by the hash of their row number; anchors
are packed into sheets that are sent to every block (a stated query set against all rows, in
blocks).  A task holds one block and one sheet at a time and reports, of each anchor, only the
first rows of its block; a window over those picks the anchor's first ones.  There are two such passes:
positives, then negatives inside each positive's score window.

Defined cases: a row with a null label, a null vector, or a null or non-finite component takes
no part; vectors of different lengths are compared as if filled up with zeros, so an empty
vector scores 0; every row counts by itself, so a repeated row can be its copy's positive and
a repeated anchor is answered once per row; a null vec_id is no anchor and comes last on ties;
an anchor without positives, or whose positives have no row in their windows, has no rows;
other columns are ignored; an empty table gives an empty result.  Scores that might not fit a long are
an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custlens.llm.tables import importable, stored, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST, MOST = 80, 100          # of a positive's score, in per cent
ANCHOR_EVERY = 100
BLOCK_COMPONENTS = 1 << 18     # of a block of rows
SHEET_COMPONENTS = 1 << 14     # of a sheet of anchors
PRIMES = [p for p in range(251, 2, -2) if all(p % q for q in range(3, 16, 2))]
_EXACT = 1 << 24               # float32 holds all integers up to here
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


# ---------------------------------------------------------------- the product

def primes_for(bound: int) -> list[int]:
    """Primes whose product exceeds ``2 * bound``, so that balanced residues tell all scores."""
    if bound >= 1 << 62:
        raise ValueError("inner products of these vectors do not fit a long")
    out = []
    while math.prod(out) <= 2 * bound + 1:
        out.append(PRIMES[len(out)])
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Integers held in float64, modulo ``p``, balanced around 0, as float32."""
    r = np.fmod(x, p)
    half = (p - 1) // 2
    r[r > half] -= p
    r[r < -half] += p
    return r.astype(np.float32)


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` (balanced, int64) for float32 residues; sums of at most ``step``
    products are exact."""
    step = _EXACT // ((p // 2) ** 2)
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for lo in range(0, a.shape[1], step):
        s = a[:, lo:lo + step] @ b[:, lo:lo + step].T
        total += s - np.rint(s * np.float32(1 / p)) * np.float32(p)
    return balanced(total.astype(np.int64), p)


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    x = np.mod(x, p)
    x[x > p // 2] -= p
    return x


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed inner products from the residue matrices: mixed-radix digits, each balanced,
    so that their weighted sum is the score itself."""
    digits, out, weight = [], None, 1
    for i, p in enumerate(primes):
        d = product_mod(a[i], b[i], p)
        radix = 1
        for j, e in enumerate(digits):
            d = d - e * (radix % p)
            radix *= primes[j]
        d = balanced(d * pow(radix, -1, p) if radix > 1 else d, p)
        digits.append(d)
        # weights are taken modulo 2^64: sums wrap around and end at the score, which fits
        w = np.uint64(weight & 0xFFFFFFFFFFFFFFFF).astype(np.int64)
        out = d.copy() if out is None else out + d * w
        weight *= p
    return out


# ---------------------------------------------------------------- blocks and sheets

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of a matrix, filled up with zeros."""
    n = len(column)
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
    size = np.diff(at)
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


def _first(anchor: np.ndarray, place: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of the entries of each anchor the first ``most`` by score, then by place; entries come in
    the order of (anchor, place)."""
    order = np.lexsort((place, -score, anchor))
    a = anchor[order]
    begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, dtype=np.int64)
    turn = np.arange(len(a)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(a)]))))
    return order[turn < most]


class _Block:
    """Rows of one block in the order of ties (vec_id, nulls last)."""

    def __init__(self, batches: list[pa.RecordBatch], width: int, primes: list[int]):
        t = pa.Table.from_batches(batches).combine_chunks()
        ids = t.column("vec_id").to_numpy(zero_copy_only=False) if not t.column("vec_id").null_count else t.column("vec_id").fill_null(_LAST).to_numpy()
        known = ~t.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, ~known))
        self.ids, self.known = ids[order], known[order]
        self.row = t.column("row").to_numpy()[order]
        self.label = t.column("label").to_numpy()[order]
        x = _matrix(t.column("x").combine_chunks(), width)[order]
        self.res = [residues(x, p) for p in primes]


def _scan(batches, width: int, primes: list[int], pick):
    """Blocks come first row by row, then their sheets' anchors, sheet by sheet."""
    block, now, held, sheet = None, None, [], None

    def answer(rows):
        t = pa.Table.from_batches(rows).combine_chunks()
        x = _matrix(t.column("x").combine_chunks(), width)
        s = scores([residues(x, p) for p in primes], block.res, primes)
        return pick(t, s, block)

    for b in batches:
        cut = np.flatnonzero(np.concatenate(([True], _changes(b, "block") | _changes(b, "sheet"))))
        for lo, hi in zip(cut, np.append(cut[1:], b.num_rows)):
            part = b.slice(lo, hi - lo)
            key = (part.column("block")[0].as_py(), part.column("sheet")[0].as_py())
            if key != now:
                if now is not None and now[1] >= 0 and held:
                    yield answer(held)
                elif now is not None and now[1] < 0:
                    block = _Block(held, width, primes)
                if now is None or key[0] != now[0]:
                    if key[1] >= 0:   # a block without rows: its sheets have nothing to meet
                        block = None
                now, held = key, []
            if key[1] < 0 or block is not None:
                held.append(part)
    if now is not None and now[1] >= 0 and held:
        yield answer(held)


def _changes(b: pa.RecordBatch, column: str) -> np.ndarray:
    v = b.column(column).to_numpy(zero_copy_only=False)
    return v[1:] != v[:-1]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the list, value) of all values."""
    lists = column.combine_chunks()
    at = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(at)), lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]


def _nullable(ids: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=~known)


def _positives(width: int, primes: list[int], most: int):
    def pick(t, s, block):
        same = t.column("label").to_numpy()[:, None] == block.label[None, :]
        same &= t.column("row").to_numpy()[:, None] != block.row[None, :]
        masked = np.where(same, s, _FIRST)
        if masked.shape[1] > most:   # nothing below an anchor's most-th best of the block can count
            same &= masked >= np.partition(masked, -most, axis=1)[:, -most, None]
        a, place = np.nonzero(same)
        keep = _first(a, place, s[a, place], most)
        a, place = a[keep], place[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(t.column("row").to_numpy()[a]), _nullable(block.ids[place], block.known[place]), pa.array(block.row[place]), pa.array(s[a, place])],
            names=["anchor", "vec_id", "row", "score"])
    return lambda batches: _scan(batches, width, primes, pick)


def _negatives(width: int, primes: list[int], most: int):
    def pick(t, s, block):
        of, low = _flat(t.column("low"))
        _, high = _flat(t.column("high"))
        least = np.full(len(s), _LAST)
        np.minimum.at(least, of, low)
        greatest = np.full(len(s), _FIRST)
        np.maximum.at(greatest, of, high)
        other = t.column("label").to_numpy()[:, None] != block.label[None, :]
        a, place = np.nonzero(other & (s >= least[:, None]) & (s <= greatest[:, None]))
        score = s[a, place]
        parts = []
        turn = np.arange(len(of)) - np.searchsorted(of, of)   # a positive's window: the turn-th of its anchor
        for j in range(int(turn.max()) + 1 if len(turn) else 0):
            mine = np.flatnonzero(turn == j)
            lo, hi = np.full(len(s), _LAST), np.full(len(s), _FIRST)
            lo[of[mine]], hi[of[mine]] = low[mine], high[mine]
            inside = np.flatnonzero((score >= lo[a]) & (score <= hi[a]))
            keep = inside[_first(a[inside], place[inside], score[inside], most)]
            parts.append((a[keep], np.full(len(keep), j, dtype=np.int32), place[keep], score[keep]))
        a, j, place, score = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64),) * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(t.column("row").to_numpy()[a]), pa.array(j.astype(np.int32)), _nullable(block.ids[place], block.known[place]), pa.array(block.row[place]), pa.array(score)],
            names=["anchor", "turn", "vec_id", "row", "score"])
    return lambda batches: _scan(batches, width, primes, pick)


# ---------------------------------------------------------------- plans

def _blocks(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_sheets: int, extra: list[str]) -> DataFrame:
    """Every block's rows (sheet -1), followed by all anchors, sheet by sheet."""
    mine = rows.select(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(-1).alias("sheet"), "row", "vec_id", "label", "x")
    sheets = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
                            F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(n_sheets)).cast("int").alias("sheet"), "row", "vec_id", "label", "x", *extra)
    return mine.unionByName(sheets, allowMissingColumns=True).repartition(n_blocks, "block").sortWithinPartitions("block", "sheet")


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x``: rows that take part, components as integers (held in doubles)."""
    x = F.transform("embedding", lambda v: _floor(v.cast("double") * F.lit(float(scale))))
    finite = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", "label", x.alias("x"))


def _floor(v: Column) -> Column:
    """Floor as a double; ``floor`` itself gives a long, which large values do not fit."""
    return F.when(F.abs(v) < F.lit(float(1 << 53)), F.floor(v).cast("double")).otherwise(v)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
                   most: int = MOST, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``; ``anchor`` says which rows are anchors (on those columns).
    A negative's score is between ``least`` and ``most`` per cent of the positive's.
    """
    importable(vectors.sparkSession)
    rows = stored(usable(vectors, scale).select(F.monotonically_increasing_id().alias("row"), "*"), "mining-rows")
    size = rows.agg(F.sum(F.size("x")).alias("all"), F.max(F.size("x")).alias("width"),
                    F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("norm"), F.count(F.lit(1)).alias("n")).first()
    width, norm = int(size["width"] or 0), float(size["norm"] or 0.0)
    if not norm < 2.0**62:
        raise ValueError("inner products of these vectors do not fit a long")
    primes = primes_for(int(norm * (1 + 1e-9)) + 1)
    per_row = max(1, int(size["all"] or 0) // max(1, size["n"]))
    n_blocks = max(1, -(-size["n"] * per_row // BLOCK_COMPONENTS))
    anchors = rows.where(anchor)
    n_sheets = max(1, -(-anchors.count() * per_row // SHEET_COMPONENTS))

    ddl = "vec_id bigint, row bigint, score bigint"
    found = _blocks(rows, anchors, n_blocks, n_sheets, []).mapInArrow(_positives(width, primes, positives), f"anchor bigint, {ddl}")
    best = stored(_ranked(found, ["anchor"], positives).select("anchor", (F.col("rank") - 1).alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mining-positives")

    # least * p <= 100 * n <= most * p holds for some n only if p >= 0 (least <= most)
    p = F.col("positive_score").cast("decimal(38,0)")
    low = F.when(F.col("positive_score") < 0, F.lit(_LAST)).otherwise(F.ceil(p * least / F.lit(100)).cast("bigint"))
    high = F.when(F.col("positive_score") < 0, F.lit(_FIRST)).otherwise(F.floor(p * most / F.lit(100)).cast("bigint"))
    windows = best.select("anchor", F.struct("turn", low.alias("low"), high.alias("high")).alias("w")).groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("w"))
    asked = anchors.join(windows.withColumnRenamed("anchor", "row"), "row").select("*", F.col("w.low").alias("low"), F.col("w.high").alias("high")).drop("w")
    found = _blocks(rows, asked, n_blocks, n_sheets, ["low", "high"]).mapInArrow(_negatives(width, primes, negatives), f"anchor bigint, turn int, {ddl}")
    ranked = _ranked(found, ["anchor", "turn"], negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(best, ["anchor", "turn"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % ANCHOR_EVERY == 0)
