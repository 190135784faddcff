"""Iterative fits over a blocked table: many models in one pass, one job a pass.

A training table is packed once into blocks of at most ``BLOCK_ROWS`` rows (one row per block: ids,
a dense matrix, labels, masks) and stored.  A pass maps every block to one vector of sums, of a size
that depends on the models only, and adds the vectors up: in the map tasks first, then in a tree
of fan-in ``FAN_IN``, so that the driver gets at most ``FAN_IN`` vectors whatever the table's size.
Several fits (starts, folds, numbers of clusters) ride on one pass, each with its own part of the vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.materialize import materialize

BLOCK_ROWS = 16_384
FAN_IN = 32
SUMS = "sums binary"


def pack(df: DataFrame, id_column: str, matrix: list[str], extra: list[str] | None = None, name: str = "blocks") -> DataFrame:
    """``ids, x, extra`` per block: ids as int64, ``matrix`` and ``extra`` row by row as float64.

    Rows keep the order of their ids inside a block, so that equal tables give equal blocks."""
    extra = extra or []
    n = df.count()
    n_blocks = max(1, -(-n // BLOCK_ROWS))
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), *[F.col(c).cast("double").alias(c) for c in [*matrix, *extra]])
    # a block's rows are bounded; the hash spreads them evenly
    rows = rows.repartition(n_blocks, F.pmod(F.xxhash64("id"), F.lit(n_blocks))).sortWithinPartitions(F.pmod(F.xxhash64("id"), F.lit(n_blocks)), "id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield _block(held, matrix, extra)
                held, size = [], 0
        if size:
            yield _block(held, matrix, extra)

    return materialize(rows.mapInArrow(packed, "n int, ids binary, x binary, extra binary"), name)


def _block(batches: list[pa.RecordBatch], matrix: list[str], extra: list[str]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches)

    def dense(columns):
        cols = [t.column(c).to_numpy() for c in columns]
        return np.ascontiguousarray(np.stack(cols, axis=1) if cols else np.zeros((t.num_rows, 0))).tobytes()

    values = [[t.num_rows], [t.column("id").to_numpy().astype(np.int64).tobytes()], [dense(matrix)], [dense(extra)]]
    return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int32())] + [pa.array(v, pa.binary()) for v in values[1:]], names=["n", "ids", "x", "extra"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, extra) of every block."""
    for b in batches:
        for n, ids, x, extra in zip(*(b.column(c).to_pylist() for c in ("n", "ids", "x", "extra"))):
            yield np.frombuffer(ids, dtype=np.int64), np.frombuffer(x).reshape(n, -1), np.frombuffer(extra).reshape(n, -1)


def block_count(blocks: DataFrame) -> int:
    return max(1, blocks.count())


def _sums_batch(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, dtype=np.float64).tobytes()], pa.binary())], names=["sums"])


def reduced(blocks: DataFrame, of_block: Callable[..., np.ndarray], n_blocks: int, combine: Callable = np.add) -> np.ndarray | None:
    """One pass: ``of_block(ids, x, extra, ...)`` of every block, combined to one vector; None without blocks."""

    def of_blocks(batches):
        total = None
        for parts in unpacked(batches):
            v = of_block(*parts)
            total = v if total is None else combine(total, v)
        if total is not None:
            yield _sums_batch(total)

    def of_sums(batches):
        total = None
        for b in batches:
            for v in b.column("sums"):
                part = np.frombuffer(v.as_buffer())
                total = part if total is None else combine(total, part)
        if total is not None:
            yield _sums_batch(total)

    out, width = blocks.mapInArrow(of_blocks, SUMS), n_blocks
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        out = out.repartition(width).mapInArrow(of_sums, SUMS)
    total = None
    for r in out.collect():   # at most FAN_IN
        part = np.frombuffer(r["sums"])
        total = part if total is None else combine(total, part)
    return total
