"""Operator 7: language-model scoring with a gated recurrent network in NumPy.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end token.
Word counts cover all training documents (crc32(doc_id as text) modulo 7 not ``HELD_OUT``): they
are counted where texts are read, merged in hash buckets, and stored.

The model: a GRU reads the tokens so far; its state gives a softmax over word classes, and within
a class a softmax over its words.  The ``HEAD`` most frequent words fall into ``HEAD_CLASSES``
classes of equal mass; all other words fall into ``SHAPES`` classes by length, ASCII and final
punctuation, where a word's share is (c + 1) / (N + V + 1) from the counts of the whole corpus;
the end token is a class of its own.  The network is trained on Spark on every token of every
training document, ``EPOCHS`` times: in a round each partition starts from the shared network, runs
truncated backpropagation (windows of ``BPTT`` steps, state carried over) over its documents of any
length, and gives its change of the weights times its tokens, of fixed size; these are summed in a
tree and their mean is the next round's network.  Scoring runs over whole texts in windows and
carries the state across them.

Counts come to the texts by two shuffles: texts lie in buckets by document, each bucket asks for
its distinct words that are not in the head, and the answers return to it.  Texts are shuffled
once.  Words are told apart by a 64-bit hash.  The head and the network are of fixed size.

Defined cases: a null or empty text is the end token alone; null ids are not learned from;
repeated rows are separate documents (training counts them all); without training tokens ``score``
is ``base_score``; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.tables import importable, stored, table
from custlens.llm.textscan import Words, scan, slices

HELD_OUT = 2
HEAD, HEAD_CLASSES, SHAPES, STATE = 4096, 60, 32, 32
BPTT, STREAMS, EPOCHS, RATE = 24, 32, 3, 0.006
MOST_STREAMS, SLICE_STEPS = 256, 256   # more streams for a slice that fills so many windows
FAN = 32                    # networks summed by a task
CHUNK_FLOATS = 1 << 16      # of a network's change in a row
SCORE_STEPS = 64
SLICE_BYTES = 8 << 20
PIECE_BYTES = 1 << 20     # of text whose words a task takes apart at a time
BUCKET_BYTES = 16 << 20   # of text for each bucket of hashes
CLASSES = HEAD_CLASSES + SHAPES + 1
END_CLASS = CLASSES - 1
TYPES = HEAD + SHAPES + 1
END_TYPE = TYPES - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LONG = np.array([4, 6, 8, 10, 12, 15, 20])
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_COUNTS = "bucket bigint, h binary, n binary, shape binary"
_ASKED = "bucket bigint, asker bigint, h binary"
_ANSWERS = "asker bigint, h binary, n binary"
_CHANGES = "part bigint, chunk bigint, sums binary"
_CHANGES_ARROW = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("sums", pa.binary())])


def lowered(texts) -> Words:
    words = scan(texts)
    words.data = _LOWER[words.data]
    return words


def shapes(words: Words) -> np.ndarray:
    """A word's class by its looks: 8 lengths, ASCII or not, punctuation at its end or not."""
    if not len(words.start):
        return np.zeros(0, dtype=np.uint8)
    high = np.concatenate(([0], np.cumsum(words.data >= 0x80)))
    foreign = high[words.end] > high[words.start]
    return (np.searchsorted(_LONG, words.end - words.start, "right") * 4 + foreign * 2 + _PUNCTUATION[words.data[words.end - 1]]).astype(np.uint8)


def _blobs(schema: str, types: list, bucket: np.ndarray, columns: list[np.ndarray], extra: list | None = None) -> pa.Table:
    """One row per bucket, its values packed; ``extra`` constants go after the bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
    if not len(bucket):
        lo = hi = np.zeros(0, dtype=np.int64)
    rows = [bucket[lo].tolist(), *[[v] * len(lo) for v in extra or ()], *[[c[a:b].tobytes() for a, b in zip(lo, hi)] for c in columns]]
    return pa.Table.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=[x.split()[0] for x in schema.split(", ")])


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=dtype)


def _merged(h: np.ndarray, n: np.ndarray, *others: np.ndarray):
    """Distinct hashes in order with their summed counts (and one of each other value)."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    return h[first], np.add.reduceat(n, first) if len(first) else n, *[o[order][first] for o in others]


def counted(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of a batch's texts in order, their counts and shapes."""
    found = []
    for piece in slices([b], "text", PIECE_BYTES):
        words = lowered(piece.column("text"))
        h = words.hashes()
        found.append(_merged(h, np.ones(len(h), dtype=np.int64), shapes(words)))
    return _merged(*[np.concatenate(x) for x in zip(*found)])


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """Word counts of ``docs``' texts: a row per hash bucket with packed (hash, count, shape)."""
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def local(batches):
        for b in slices(batches, "text", SLICE_BYTES):
            h, n, shape = counted(b)
            yield from _blobs(_COUNTS, types, (h % np.uint64(buckets)).astype(np.int64), [h, n, shape]).to_batches()

    def merge(key, t):
        h, n, shape = _merged(_joined(t.column("h"), np.uint64), _joined(t.column("n"), np.int64), _joined(t.column("shape"), np.uint8))
        return _blobs(_COUNTS, types, np.full(len(h), key[0].as_py(), dtype=np.int64), [h, n, shape])

    return docs.select("text").mapInArrow(local, _COUNTS).groupBy("bucket").applyInArrow(merge, _COUNTS)


@dataclass
class Vocabulary:
    head: np.ndarray         # hashes of the head words, ascending
    head_count: np.ndarray
    head_class: np.ndarray
    shape_tokens: np.ndarray  # tokens and distinct words beyond the head, by shape
    shape_words: np.ndarray
    tokens: int              # of all training documents, ends included
    words: int               # distinct, the end included
    docs: int                # training documents

    def types(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.head, h), max(len(self.head) - 1, 0))
        known = self.head[at] == h if len(self.head) else np.zeros(len(h), dtype=bool)
        return np.where(known, at, HEAD + shape.astype(np.int64))

    def classes(self, types: np.ndarray) -> np.ndarray:
        out = types - HEAD + HEAD_CLASSES
        out[types == END_TYPE] = END_CLASS
        head = types < HEAD
        out[head] = self.head_class[types[head]]
        return out


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """From stored counts; the driver gets ``HEAD`` words and sums."""
    spark = counts.sparkSession

    def sizes(batches):   # words by the power of two below their count
        total = np.zeros(64, dtype=np.int64)
        for b in batches:
            for n in b.column("n"):
                total += np.bincount(np.log2(np.frombuffer(n.as_py(), np.int64)).astype(np.int64), minlength=64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(total)], names=["power", "words"])

    by_power = {r["power"]: r["words"] for r in counts.select("n").mapInArrow(sizes, "power bigint, words bigint").groupBy("power").agg(F.sum("words").alias("words")).collect()}
    least, enough = 0, 0
    for power in sorted(by_power, reverse=True):
        enough += by_power[power]
        if enough >= HEAD:   # so the head lies among the words of this count or more
            least = 1 << power
            break

    def top(batches):
        for b in batches:
            for h, n in zip(b.column("h"), b.column("n")):
                h, n = np.frombuffer(h.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)
                often = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(h[often]), pa.array(n[often])], names=["h", "n"])

    rows = counts.select("h", "n").mapInArrow(top, "h bigint, n bigint").orderBy(F.desc("n"), "h").limit(HEAD).collect()
    head = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
    number = np.array([r["n"] for r in rows], dtype=np.int64)
    order = np.argsort(head)
    mass = np.cumsum(number) - number / 2   # rows come by descending count
    head_class = np.minimum((mass * HEAD_CLASSES / max(number.sum(), 1)).astype(np.int64), HEAD_CLASSES - 1)
    head, number, head_class = head[order], number[order], head_class[order]

    def rest(batches):
        for b in batches:
            for h, n, s in zip(b.column("h"), b.column("n"), b.column("shape")):
                h, n, s = np.frombuffer(h.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64), np.frombuffer(s.as_py(), np.uint8)
                beyond = ~np.isin(h, head)
                s, n = s[beyond], n[beyond]
                tokens = np.bincount(s, n, SHAPES).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(tokens), pa.array(np.bincount(s, minlength=SHAPES))], names=["shape", "n", "v"])

    sums = counts.select("h", "n", "shape").mapInArrow(rest, "shape bigint, n bigint, v bigint").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    tokens, distinct = np.zeros(SHAPES, dtype=np.int64), np.zeros(SHAPES, dtype=np.int64)
    for r in sums:
        tokens[r["shape"]], distinct[r["shape"]] = r["n"], r["v"]
    return Vocabulary(head, number, head_class, tokens, distinct, int(number.sum() + tokens.sum()) + n_docs, len(head) + int(distinct.sum()) + (n_docs > 0), n_docs)


@dataclass
class Network:
    inputs: np.ndarray      # TYPES, 3 * STATE: what a token adds to the gates
    recur: np.ndarray       # STATE, 3 * STATE
    to_class: np.ndarray    # STATE, CLASSES
    class_bias: np.ndarray
    to_word: np.ndarray     # HEAD, STATE
    word_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def _gates(net: Network, h: np.ndarray, x: np.ndarray):
    g = h @ net.recur
    s = STATE
    r = 1 / (1 + np.exp(-(x[:, :s] + g[:, :s])))
    z = 1 / (1 + np.exp(-(x[:, s:2 * s] + g[:, s:2 * s])))
    n = np.tanh(x[:, 2 * s:] + r * g[:, 2 * s:])
    return r, z, n, g[:, 2 * s:], n + z * (h - n)


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1)
    return logits[np.arange(len(at)), at] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))


def _members(v: Vocabulary) -> list[np.ndarray]:
    return [np.flatnonzero(v.head_class == c) for c in range(HEAD_CLASSES)]


def new_network(v: Vocabulary, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    f32 = lambda a: np.ascontiguousarray(a, dtype=np.float32)
    mass = np.bincount(v.head_class, v.head_count, HEAD_CLASSES) if len(v.head) else np.zeros(HEAD_CLASSES)
    empty = np.concatenate((mass == 0, np.zeros(SHAPES + 1, dtype=bool)))   # no word can fall into these
    mass = np.concatenate((mass, v.shape_tokens, [v.docs])) + 1.0
    word_bias = np.zeros(HEAD)
    word_bias[:len(v.head)] = np.log(v.head_count)
    return Network(f32(rng.normal(0, 0.15, (TYPES, 3 * STATE))), f32(rng.normal(0, STATE ** -0.5, (STATE, 3 * STATE))), f32(rng.normal(0, 0.05, (STATE, CLASSES))),
                   f32(np.where(empty, -30.0, np.log(mass / mass.sum()))), f32(rng.normal(0, 0.05, (HEAD, STATE))), f32(word_bias))


class Adam:
    """Moments of a network's weights, and its steps."""

    def __init__(self, net: Network):
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
        self.steps = 0

    def step(self, net: Network, grads: list[np.ndarray], rate: float) -> None:
        norm = np.sqrt(sum(float((x * x).sum()) for x in grads))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        self.steps += 1
        rate *= (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        for w, x, (m1, m2) in zip(net.parts(), grads, self.moments):
            x = x * np.float32(scale)
            m1 += 0.1 * (x - m1)
            m2 += 0.001 * (x * x - m2)
            w -= (rate * m1 / (np.sqrt(m2) + 1e-8)).astype(np.float32)


def _places(members: list[np.ndarray]) -> np.ndarray:
    place = np.zeros(HEAD, dtype=np.int64)   # of a head word within its class
    for m in members:
        place[m] = np.arange(len(m))
    return place


def _window(net: Network, v: Vocabulary, members: list[np.ndarray], place: np.ndarray, window: np.ndarray, before: np.ndarray, h: np.ndarray):
    """Gradients of the mean loss over a window (streams x steps; -1 where a stream is over), the
    tokens read, and the last tokens and states."""
    b = len(window)
    trace, states = [], []
    for t in range(window.shape[1]):
        fresh = before == END_TYPE   # a document begins: no state
        h_in = np.where(fresh[:, None], np.float32(0), h)
        r, z, n, g, h = _gates(net, h_in, net.inputs[before])
        trace.append((before, fresh, h_in, r, z, n, g))
        states.append(h)
        before = np.where(window[:, t] < 0, END_TYPE, window[:, t])
    hs, target = np.concatenate(states), window.T.reshape(-1)
    live = target >= 0
    target = np.where(live, target, END_TYPE)
    grads = [np.zeros_like(p) for p in net.parts()]
    count = int(live.sum())
    share = (live / max(count, 1)).astype(np.float32)
    # classes
    cls = v.classes(target.copy())
    logits = hs @ net.to_class + net.class_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(target)), cls] -= 1
    p *= share[:, None]
    grads[2], grads[3] = hs.T @ p, p.sum(axis=0)
    d_hs = p @ net.to_class.T
    # words within the head's classes (a stream that is over has the end's class)
    by = np.argsort(cls, kind="stable")
    edge = np.searchsorted(cls[by], np.arange(HEAD_CLASSES + 1))
    for c in range(HEAD_CLASSES):
        m, at = members[c], by[edge[c]:edge[c + 1]]
        if len(m) < 2 or not len(at):
            continue
        of, words = hs[at], net.to_word[m]
        logits = of @ words.T + net.word_bias[m]
        q = np.exp(logits - logits.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(at)), place[target[at]]] -= 1
        q *= share[at][:, None]
        grads[4][m], grads[5][m] = q.T @ of, q.sum(axis=0)
        d_hs[at] += q @ words
    # back through the window
    d_h = np.zeros((b, STATE), dtype=np.float32)
    d_inputs = []
    for t in reversed(range(len(trace))):
        _, fresh, h_in, r, z, n, g = trace[t]
        d = d_hs[t * b:(t + 1) * b] + d_h
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h_in - n) * z * (1 - z)
        d_r = d_n * g * r * (1 - r)
        d_inputs.append(np.concatenate((d_r, d_z, d_n), axis=1))
        d_g = np.concatenate((d_r, d_z, d_n * r), axis=1)
        grads[1] += h_in.T @ d_g
        d_h = np.where(fresh[:, None], np.float32(0), d * z + d_g @ net.recur.T)
    read = np.concatenate([x[0] for x in trace])
    d_inputs = np.concatenate(d_inputs[::-1])
    order = np.argsort(read, kind="stable")
    first = np.flatnonzero(np.diff(read[order], prepend=-1))
    grads[0][read[order][first]] = np.add.reduceat(d_inputs[order], first, axis=0)
    return grads, read[live], before, h


def train(v: Vocabulary, streams: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """``streams`` (streams x time): token types, each document ending with ``END_TYPE``."""
    net = new_network(v, seed)
    members = _members(v)
    place, adam = _places(members), Adam(net)
    total = epochs * max(1, -(-streams.shape[1] // BPTT))
    for _ in range(epochs):
        h, before = np.zeros((len(streams), STATE), dtype=np.float32), np.full(len(streams), END_TYPE)
        for lo in range(0, streams.shape[1], BPTT):
            grads, _, before, h = _window(net, v, members, place, streams[:, lo:lo + BPTT], before, h)
            adam.step(net, grads, RATE * (1 - (adam.steps + 1) / (total + 1)))
    return net


def network_log10(net: Network, v: Vocabulary, types: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document log10 of the classes' and the head words' probabilities; ``types`` holds the
    documents' tokens one after the other, document i at first[i]:first[i + 1]."""
    members = _members(v)
    place = _places(members)
    words_of = [(np.ascontiguousarray(net.to_word[m].T), net.word_bias[m]) for m in members]
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")   # documents that still run are the first ones
    size, start = size[order], first[:-1][order]
    out = np.zeros(len(size))
    h = np.zeros((len(size), STATE), dtype=np.float32)
    before = np.full(len(size), END_TYPE)
    for lo in range(0, int(size.max(initial=0)), SCORE_STEPS):
        states, docs, target = [], [], []
        for t in range(lo, lo + SCORE_STEPS):
            k = int(np.searchsorted(-size, -t, "left"))   # size > t
            if not k:
                break
            h = _gates(net, h[:k], net.inputs[before[:k]])[4]
            before = types[start[:k] + t]
            states.append(h)
            docs.append(np.arange(k))
            target.append(before)
        hs, at, target = np.concatenate(states), np.concatenate(docs), np.concatenate(target)
        cls = v.classes(target.copy())
        gain = _log_softmax_at(hs @ net.to_class + net.class_bias, cls).astype(np.float64)
        by = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[by], np.arange(HEAD_CLASSES + 1))
        for c in range(HEAD_CLASSES):
            mine = by[edge[c]:edge[c + 1]]
            if len(mine) and len(members[c]) > 1:
                w, bias = words_of[c]
                gain[mine] += _log_softmax_at(hs[mine] @ w + bias, place[target[mine]])
        out += np.bincount(at, gain, len(out))
    result = np.empty(len(out))
    result[order] = out / np.log(10)
    return result


def _streams(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of the tokens cut into equal streams (-1 after the last), and the token before each."""
    b = int(np.clip(len(flat) // (BPTT * SLICE_STEPS), STREAMS, MOST_STREAMS))
    width = -(-len(flat) // b)
    padded = np.full(b * width, -1, dtype=np.int64)
    padded[:len(flat)] = flat
    streams = padded.reshape(b, width)
    before = np.concatenate(([END_TYPE], streams[:-1, -1]))
    return streams, np.where(before < 0, END_TYPE, before)


def token_types(docs: DataFrame, vocabulary_of) -> DataFrame:
    """The types of all tokens of ``docs``, documents one after the other, each ended: a row per slice."""

    def local(batches):
        v = vocabulary_of.value
        for b in slices(batches, "text", SLICE_BYTES):
            types = []
            for piece in slices([b], "text", PIECE_BYTES):
                words = lowered(piece.column("text"))
                types.append(np.insert(v.types(words.hashes(), shapes(words)), words.first[1:], END_TYPE).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(types)], pa.binary())], names=["types"])

    return docs.select("text").mapInArrow(local, "types binary")


def _summed(parts: DataFrame, partitions: int) -> np.ndarray:
    """The sum of the partitions' vectors (part, chunk, sums), at most ``FAN`` of a chunk by a task."""

    def add(key, t):
        total = np.sum([np.frombuffer(x.as_py(), np.float32) for x in t.column("sums")], axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "chunk": pa.array([key[1].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "chunk").applyInArrow(add, _CHANGES)
        if partitions <= FAN:
            break
        partitions = -(-partitions // FAN)
    rows = parts.collect()   # one network's chunks
    return np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(rows, key=lambda r: r["chunk"])]) if rows else np.zeros(0, np.float32)


def learn(types: DataFrame, v: Vocabulary, epochs: int = EPOCHS, seed: int = 11) -> tuple[Network, int]:
    """The network after ``epochs`` rounds over all of ``types``, and the tokens of a round.

    A type's input weights change by the mean over the tokens of that type, all others by the mean
    over all tokens."""
    spark = types.sparkSession
    net, tokens = new_network(v, seed), 0
    partitions = types.rdd.getNumPartitions()
    for turn in range(epochs):
        shared = spark.sparkContext.broadcast((net, v))   # fixed size
        rate = RATE * (1 - turn / epochs)

        def local(batches):
            old, v = shared.value
            net = Network(*[p.copy() for p in old.parts()])
            members = _members(v)
            place, adam, seen = _places(members), Adam(net), np.zeros(TYPES)
            for batch in batches:
                for x in batch.column("types"):
                    streams, before = _streams(np.frombuffer(x.as_py(), np.uint16))
                    h = np.zeros((len(streams), STATE), dtype=np.float32)
                    for lo in range(0, streams.shape[1], BPTT):
                        grads, read, before, h = _window(net, v, members, place, streams[:, lo:lo + BPTT], before, h)
                        adam.step(net, grads, rate)
                        seen += np.bincount(read, minlength=TYPES)
            if not seen.any():
                return
            change = [(new - was) * (seen[:, None] if i == 0 else seen.sum()) for i, (new, was) in enumerate(zip(net.parts(), old.parts()))]
            flat = np.concatenate([c.reshape(-1) for c in [*change, seen]]).astype(np.float32)
            for i, lo in enumerate(range(0, len(flat), CHUNK_FLOATS)):
                yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "chunk": i, "sums": flat[lo:lo + CHUNK_FLOATS].tobytes()}], schema=_CHANGES_ARROW)

        flat = _summed(types.mapInArrow(local, _CHANGES), partitions)
        shared.unpersist()
        if not len(flat):
            return net, 0
        seen = flat[-TYPES:].astype(np.float64)
        tokens, lo, parts = int(round(seen.sum())), 0, []
        for i, p in enumerate(net.parts()):
            change = flat[lo:lo + p.size].reshape(p.shape)
            parts.append((p + change / (np.maximum(seen, 1)[:, None] if i == 0 else seen.sum())).astype(np.float32))
            lo += p.size
        net = Network(*parts)
    return net, tokens


def training_documents(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 != HELD_OUT)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    importable(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    learned = training_documents(docs)
    counts = stored(count_words(learned, buckets), "lm-counts")
    n_docs = learned.count()
    v = vocabulary(counts, n_docs)
    net = learn(stored(token_types(learned, spark.sparkContext.broadcast(v)), "lm-types"), v)[0] if v.tokens else new_network(v)
    model = spark.sparkContext.broadcast((net, v))   # fixed size: HEAD words and the network

    rows = docs.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * buckets)))
    keyed = rows.groupBy("_bucket")
    asked_types, answer_types = [pa.int64(), pa.int64(), pa.binary()], [pa.int64(), pa.binary(), pa.binary()]

    def ask(key, t):
        v = model.value[1]
        h = np.unique(np.concatenate([np.unique(lowered(piece.column("text")).hashes()) for piece in slices(t.to_batches(), "text", PIECE_BYTES)]))
        h = h[~np.isin(h, v.head)]
        return _blobs(_ASKED, asked_types, (h % np.uint64(buckets)).astype(np.int64), [h], [key[0].as_py()])

    def answer(key, c, q):
        known, n = _joined(c.column("h"), np.uint64), _joined(c.column("n"), np.int64)
        found = []
        for asker, h in zip(q.column("asker").to_pylist(), q.column("h")):
            h = np.frombuffer(h.as_py(), np.uint64)
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
            found.append((asker, h[hit].tobytes(), n[at[hit]].tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 3, answer_types)], names=["asker", "h", "n"])

    out_types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    out_schema = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    out_names = [x.split()[0] for x in out_schema.split(", ")]

    def score(_, t, a):
        known, n = _merged(_joined(a.column("h"), np.uint64), _joined(a.column("n"), np.int64))
        done = [scored(piece, known, n) for piece in slices(t.to_batches(), "text", PIECE_BYTES)]
        return pa.concat_tables(done) if done else pa.schema(list(zip(out_names, out_types))).empty_table()

    def scored(t, known, n):
        net, v = model.value
        words = lowered(t.column("text"))
        h, shape = words.hashes(), shapes(words)
        types = v.types(h, shape)
        count = np.zeros(len(h), dtype=np.int64)
        head = types < HEAD
        count[head] = v.head_count[types[head]]
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = ~head & (known[at] == h)
            count[hit] = n[at[hit]]
        doc, docs_here = words.doc(), t.num_rows
        total = float(v.tokens + v.words + 1)
        base = np.bincount(doc, np.log10((count + 1) / total), docs_here) + np.log10((v.docs + 1) / total)
        n_known = np.bincount(doc, count > 0, docs_here).astype(np.int64) + (v.docs > 0)
        if v.tokens:
            rest = ~head
            s = shape[rest]
            inside = np.log10((count[rest] + 1) / (v.shape_tokens[s] + v.shape_words[s] + 1.0))
            first = words.first + np.arange(docs_here + 1)
            by_model = network_log10(net, v, np.insert(types, words.first[1:], END_TYPE), first) + np.bincount(doc[rest], inside, docs_here)
        else:
            by_model = base
        columns = [t.column("doc_id"), words.n_words + 1, n_known, base, by_model]
        return pa.Table.from_arrays([c if i == 0 else pa.array(c, k) for i, (c, k) in enumerate(zip(columns, out_types))], names=out_names)

    asked = keyed.applyInArrow(ask, _ASKED)
    answers = counts.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, _ANSWERS)
    out = keyed.cogroup(answers.groupBy("asker")).applyInArrow(score, out_schema)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(v.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
