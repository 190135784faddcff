"""Operator 2: quality classifier, a byte-level convolutional network in NumPy.

A text's UTF-8 bytes become ``DIM`` numbers each (byte class, and a fixed code of the byte);
``FILTERS`` learned filters span ``SPAN`` bytes and run over the whole text in steps of
``STEP``.  Responses are max-pooled over chunks of ``2 * BLOCK`` bytes that overlap by half; a
document's chunks are combined by their mean, maximum and minimum, which with the text's length
go through a small hidden layer into one probability.

The network is fitted on the driver, on at most ``TRAIN_PER_LABEL`` labelled documents of each
label, of at most ``TRAIN_BYTES`` bytes together (both parameters).  Long documents are learned from
whole; a text that no longer fits what is left of the bytes gives its turn to the next one, among the
first ``TRAIN_CANDIDATES`` times as many by the hash of their ids.  Labels are learned only from
documents whose crc32(doc_id as text) modulo 4 is not ``HELD_OUT``.  The fitted network is a few
thousand numbers and travels in the task closure.  Scoring is one pass over the texts where they
are read, in tiles of bounded size, without a shuffle.

Defined cases: a null text counts as empty; an empty text has zeros for every pooled response
and gets a score like any other; repeated rows give repeated results; a label or id that is null
is not learned from, nor is a text of more than ``TRAIN_BYTES``; without labelled documents of both kinds
every score is the share of label 1 (1.0 if there are no labels); other columns are ignored by ``score_documents`` and passed on by
``keep_good``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from custlens.llm.tables import importable, set_aside, table
from custlens.llm.textscan import slices

SPAN, STEP, BLOCK, FILTERS, HIDDEN = 8, 2, 128, 32, 24
TILE_BLOCKS = 512
TRAIN_PER_LABEL = 1200
TRAIN_BYTES = 8 << 20
TRAIN_CANDIDATES = 4
EPOCHS, BATCH, RATE = 14, 32, 0.004
GOOD_WEIGHT = 0.7
HELD_OUT = 2
KEEP_SCORE = 0.7
_NONE = np.float32(-1e30)


def _codes() -> np.ndarray:
    """A row per byte: its class (one of six) and two fixed pseudo-random numbers."""
    out = np.zeros((256, 8), dtype=np.float32)
    kinds = [range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100), range(0x30, 0x3A), (0x09, 0x0A, 0x0D, 0x20), [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]]
    for i, kind in enumerate(kinds):
        out[list(kind), i] = 1
    out[1:, 6:] = np.random.default_rng(1).normal(0, 0.7, (255, 2))
    return out


CODES = _codes()
DIM = CODES.shape[1]


@dataclass
class Network:
    filters: np.ndarray   # SPAN * DIM, FILTERS
    bias: np.ndarray      # FILTERS
    hidden: np.ndarray    # 3 * FILTERS + 1, HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray       # HIDDEN
    out_bias: np.ndarray  # 1
    constant: float | None = None   # the score of everything, if nothing could be learned

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    f32 = lambda a: a.astype(np.float32)
    return Network(f32(rng.normal(0, (SPAN * DIM) ** -0.5, (SPAN * DIM, FILTERS))), np.zeros(FILTERS, np.float32),
                   f32(rng.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS + 1, HIDDEN))), np.zeros(HIDDEN, np.float32),
                   f32(rng.normal(0, HIDDEN ** -0.5, HIDDEN)), np.zeros(1, np.float32))


@dataclass
class Laid:
    """Texts laid out in blocks: each begins at a block and ends with at least SPAN zero bytes."""

    data: np.ndarray    # uint8, whole blocks and SPAN more bytes
    valid: np.ndarray   # windows of each block that begin inside the text
    first: np.ndarray   # block range of each text
    size: np.ndarray    # bytes of each text


def lay_out(data: np.ndarray, offsets: np.ndarray) -> Laid:
    size = np.diff(offsets)
    blocks = -(-(size + SPAN) // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(int(first[-1]) * BLOCK + SPAN, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], size)] = data
    inside = np.repeat(size, blocks) - (np.arange(first[-1]) - np.repeat(first[:-1], blocks)) * BLOCK
    return Laid(out, np.clip(-(-inside // STEP), 0, BLOCK // STEP), first, size)


def _tile(laid: Laid, lo: int, hi: int) -> np.ndarray:
    """The windows of blocks lo..hi, one row each."""
    x = CODES[laid.data[lo * BLOCK:hi * BLOCK + SPAN]]
    rows = (hi - lo) * BLOCK // STEP
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (rows, SPAN * DIM), (STEP * DIM * 4, 4)))


def pool_blocks(net: Network, laid: Laid, keep: bool = False):
    """Largest response of each filter in each block (``_NONE`` where it has no window), and
    with ``keep`` the places of the maxima, tile by tile."""
    n, per = int(laid.first[-1]), BLOCK // STEP
    pooled = np.empty((n, FILTERS), dtype=np.float32)
    kept = []
    for lo in range(0, n, TILE_BLOCKS):
        hi = min(n, lo + TILE_BLOCKS)
        x = _tile(laid, lo, hi)
        y = (x @ net.filters).reshape(hi - lo, per, FILTERS)
        part = np.flatnonzero(laid.valid[lo:hi] < per)
        y[part] = np.where(np.arange(per)[None, :, None] < laid.valid[lo:hi][part, None, None], y[part], _NONE)
        if keep:
            at = y.argmax(axis=1)
            kept.append(at)
            pooled[lo:hi] = np.take_along_axis(y, at[:, None, :], axis=1)[:, 0]
        else:
            pooled[lo:hi] = y.max(axis=1)
    return pooled, kept


def chunk_layout(laid: Laid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second block of each chunk, and where each text's chunks begin."""
    blocks = np.diff(laid.first)
    chunks = np.maximum(blocks - 1, 1)
    begin = np.concatenate(([0], np.cumsum(chunks)))
    one = np.arange(begin[-1]) - np.repeat(begin[:-1], chunks) + np.repeat(laid.first[:-1], chunks)
    return one, np.minimum(one + 1, np.repeat(laid.first[1:] - 1, chunks)), begin


def _combine(net: Network, laid: Laid, pooled: np.ndarray):
    one, two, begin = chunk_layout(laid)
    chunk = np.maximum(pooled[one], pooled[two])
    live = np.where(chunk > _NONE / 2, np.maximum(chunk + net.bias, 0), 0)
    starts, n = begin[:-1], np.diff(begin)[:, None].astype(np.float32)
    top, low = np.maximum.reduceat(live, starts), np.minimum.reduceat(live, starts)
    features = np.concatenate((np.add.reduceat(live, starts) / n, top, low, np.log2(laid.size[:, None] + 1).astype(np.float32) / 10), axis=1)
    h = np.tanh(features @ net.hidden + net.hidden_bias)
    return 1 / (1 + np.exp(-(h @ net.out + net.out_bias[0]).astype(np.float64))), (one, two, begin, chunk, live, top, low, features, h)


def score(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    if net.constant is not None:
        return np.full(len(offsets) - 1, net.constant)
    laid = lay_out(data, offsets)
    return _combine(net, laid, pool_blocks(net, laid)[0])[0]


def _gradients(net: Network, laid: Laid, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    pooled, kept = pool_blocks(net, laid, keep=True)
    p, (one, two, begin, chunk, live, top, low, features, h) = _combine(net, laid, pooled)
    d = ((p - y) * w / len(y)).astype(np.float32)
    d_h = d[:, None] * net.out * (1 - h * h)
    d_f = d_h @ net.hidden.T
    n = np.diff(begin)
    up = lambda a: np.repeat(a, n, axis=0)
    mean, most, least = d_f[:, :FILTERS], d_f[:, FILTERS:2 * FILTERS], d_f[:, 2 * FILTERS:3 * FILTERS]
    def tied(best: np.ndarray, g: np.ndarray) -> np.ndarray:   # chunks that tie share the gradient
        same = live == up(best)
        return same * up(g / np.add.reduceat(same, begin[:-1], dtype=np.float32))

    d_live = up(mean / n[:, None]) + tied(top, most) + tied(low, least)
    d_live *= live > 0
    d_block = np.zeros_like(pooled)
    second = pooled[two] > pooled[one]
    np.add.at(d_block, one, np.where(second, 0, d_live))
    np.add.at(d_block, two, np.where(second, d_live, 0))
    d_filters = np.zeros_like(net.filters)
    per, lo = BLOCK // STEP, 0
    for at in kept:   # a tile's windows are made again rather than held: a batch may have very long texts
        x = _tile(laid, lo, lo + len(at))
        rows = np.arange(len(at))[:, None] * per + at
        g = d_block[lo:lo + len(at)]
        for f in range(FILTERS):
            d_filters[:, f] += g[:, f] @ x[rows[:, f]]
        lo += len(at)
    return [d_filters, d_live.sum(axis=0), features.T @ d_h, d_h.sum(axis=0), h.T @ d, d.sum(keepdims=True)]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the logistic loss; label 1 has ``GOOD_WEIGHT`` of the weight."""
    net = new_network(seed)
    share = float(labels.mean()) if len(labels) else 1.0
    if share in (0.0, 1.0):
        net.constant = share
        return net
    weight = np.where(labels == 1, GOOD_WEIGHT / share, (1 - GOOD_WEIGHT) / (1 - share))
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            batch = [texts[i] for i in pick]
            laid = lay_out(np.frombuffer(b"".join(batch), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in batch]))))
            step += 1
            rate = RATE * (1 - step / (total + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for p, g, (m, v) in zip(net.parts(), _gradients(net, laid, labels[pick], weight[pick]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


def fitting(sizes: list[tuple[int, int]], most: int, most_bytes: int) -> list[int]:
    """Ids of ``(id, bytes)``, in the given order, that fit what the ones before them left."""
    out, left = [], most_bytes
    for i, size in sizes:
        if len(out) < most and size <= left:
            out.append(i)
            left -= size
    return out


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(text, label) of at most ``per_label`` documents and ``most_bytes`` bytes a label, by the hash of their ids."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT).groupBy("doc_id").agg(F.max("label").alias("label"))
    top = None
    for label in (0, 1):   # a bounded number of ids: two top lists
        mine = known.where(F.col("label") == label).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(TRAIN_CANDIDATES * per_label)
        top = mine if top is None else top.unionByName(mine)
    candidates = spark.createDataFrame(top.collect(), "doc_id bigint, label int, turn bigint")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a row per candidate: the least text of an id that has several is the one learned from
    sizes = texts.join(F.broadcast(candidates), "doc_id").groupBy("label", "turn", "doc_id").agg(F.octet_length(F.min("text")).alias("size")).collect()
    chosen = []
    for label in (0, 1):
        mine = sorted((r["turn"], r["doc_id"], r["size"]) for r in sizes if r["label"] == label)
        chosen += [(i, label) for i in fitting([(i, size) for _, i, size in mine], per_label, most_bytes)]
    ids = spark.createDataFrame(chosen, "doc_id bigint, label int")
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.select("doc_id", F.encode("text", "UTF-8").alias("text"), "label")


def learn(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, most_bytes: int = TRAIN_BYTES) -> Network:
    rows = sorted(training_rows(docs, labels, per_label, most_bytes).collect(), key=lambda r: r["doc_id"])
    return fit([bytes(r["text"]) for r in rows], np.array([r["label"] for r in rows], dtype=np.float64))


def _scored(net: Network, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column):
            texts = pc.fill_null(b.column(column).cast(pa.large_binary()), b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
            p = score(net, data, offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "_score"])
    return run


def with_scores(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` and ``_score``: the probability that the text's quality is 1."""
    importable(docs.sparkSession)
    return docs.mapInArrow(_scored(net, "text"), StructType([*docs.schema.fields, StructField("_score", DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP_SCORE) -> DataFrame:
    """The documents that score ``least`` or more, with their columns."""
    rows, back = set_aside(docs)
    return back(with_scores(rows, learn(rows, labels)).where(F.col("_score") >= least))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = with_scores(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), learn(docs, labels))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False)).alias("held_out"),
                      F.col("_score").alias("score"), (F.col("_score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
