"""Operator 11: spelling variants by a relational trie frontier.

Words and their counts are gathered from all texts; then all pairs of words that are one edit
apart (a code point inserted, deleted or replaced) are found by walking tries that are stored as
tables of edges.

There is one trie per direction (words read forwards, words read backwards) and word length; a
node is a 64-bit hash of these and the prefix that leads to it.  A state is (word, position,
node, edits).  Its part without edits is the word's own path, so states without edits exist at every
depth from half of the word on: an edit in the first half of a word is one in the second half of the
reversed word.  Edits are made where the paths part: a replacement goes on to the node's other
children (towards larger code points only, the pair is mirrored at the end), a deletion goes on
in the trie of the words that are one shorter; insertions are mirrored deletions.  States with an edit then
follow their rest, one join with the edge table a round, until no state is left; each round asks
for the edge that is twice as deep below the edit (an edge implies those above it), so that a rest of
m code points takes log m rounds.  An edge that leads to a single word ends the walk: the rest is compared by hash.  An edge that leads to
more words carries a mask of their rests' hashes, so that hopeless states are not shuffled.

Hashes only propose: every proposed pair of words is checked by its edit distance, and two prefixes with
one hash share their children, so no pair is lost.

Defined cases: a null text has no words; a null doc_id counts as empty in ``<doc_id>:<run>``;
rows that repeat count again; runs of any length are words (code points are hashed one by one, in slices);
a word without near words has itself as root; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.tables import importable, stored, table
from custlens.llm.textscan import mix, slices

DROP_EVERY = 31
LEAST_CHARS = 7
LEAST_COUNT = 2
FORM_RATIO = 10
SLICE_BYTES = 8 << 20
PATH_CHARS = 1 << 18     # code points whose paths are made at a time
SHORT_RUN = 64           # bytes; the checksums of longer runs are taken one by one

_LETTER = mix(np.arange(1, 257, dtype=np.uint64))
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_CRC = np.zeros(256, dtype=np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


# ---------------------------------------------------------------- words

def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs of A-Z, a-z and U+00C0 to U+00FF in texts that lie one after
    the other; the latter are the bytes C3 and a continuation byte."""
    low = data | 0x20
    ink = ((low >= 0x61) & (low <= 0x7A)) | (data == 0xC3)
    ink[1:] |= data[:-1] == 0xC3
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cut] = ink[cut]
    ends[cut - 1] = ink[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of what gave ``state`` followed by each span."""
    out = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    fewer = -np.minimum(size, SHORT_RUN + 1)
    order = np.argsort(fewer, kind="stable")
    at, left, fewer, c = start[order], size[order], fewer[order], out[order]
    long_ = int(np.searchsorted(fewer, -SHORT_RUN, "left"))   # the first ones are longer
    for j in range(SHORT_RUN):
        n = int(np.searchsorted(fewer, -j, "left"))           # those with a byte at j
        if n <= long_:
            break
        c[long_:n] = _CRC[(c[long_:n] ^ data[at[long_:n] + j]) & 0xFF] ^ (c[long_:n] >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(long_):
        c[i] = zlib.crc32(data[at[i]:at[i] + left[i]].tobytes(), int(state[order[i]]))
    out[order] = c
    return out


def _count(batches):
    """(word, n) of each slice: runs, less a code point where the checksum says so, of at least
    ``LEAST_CHARS`` code points."""
    for b in slices(batches, "text", SLICE_BYTES):
        texts = pc.fill_null(b.column("text").cast(pa.large_string()), "")
        _, off, buf = texts.buffers()
        offsets = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(buf, dtype=np.uint8)[offsets[0]:offsets[-1]] if buf is not None else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        start, end = _runs(data, offsets)
        lead = np.concatenate(([0], np.cumsum(data == 0xC3)))
        chars = end - start - (lead[end] - lead[start])
        some = np.flatnonzero(chars >= LEAST_CHARS)
        if not len(some):
            continue
        start, end, chars = start[some], end[some], chars[some]
        upper = (data >= 0x41) & (data <= 0x5A)
        data = data + (upper.astype(np.uint8) << 5)
        ids = ["" if d is None else str(d) for d in b.column("doc_id").to_pylist()]
        head = np.array([zlib.crc32(f"{d}:".encode()) for d in ids], dtype=np.uint32)
        h = _checksums(data, start, end - start, head[np.searchsorted(offsets, start, "right") - 1])
        cut = h % DROP_EVERY == 0
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), *_gathered(data, start[~cut], end[~cut]))
        shorter = [_without(data[s:e].tobytes(), int(x) % int(n)) for s, e, x, n in zip(start[cut], end[cut], h[cut], chars[cut]) if n > LEAST_CHARS]
        words = pa.concat_arrays([whole, pa.array(shorter, pa.large_binary())])
        t = pa.table({"word": words}).group_by("word").aggregate([([], "count_all")])
        t = t.rename_columns(["n" if c == "count_all" else c for c in t.column_names])
        yield from pa.table({"word": t.column("word").cast(pa.large_string()).cast(pa.string()), "n": t.column("n")}).to_batches()


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    taken = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)]


def _without(word: bytes, at: int) -> bytes:
    w = word.decode()
    return (w[:at] + w[at + 1:]).encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word that occurs at least ``LEAST_COUNT`` times."""
    importable(docs.sparkSession)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- the tries

_ONE = np.ones(1, dtype=np.uint64)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
STATES = "node bigint, who bigint, rest bigint, meta bigint"


def _rows(ids, words, backwards, depth=None, deletions=False):
    """A row per code point of each word from half of it on (or of the code point at ``depth``):
    ``node`` of what precedes it in the trie of the word's length, ``who`` (id and code point), ``rest``, the hash
    of what follows it, and ``meta`` (depth and direction).

    With ``deletions`` the rows say where the word without that code point goes on in the trie of the
    words one shorter: by its next code point, if that is another one (else the paths part further
    on); without its last code point, by the one before."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    # all words are letters below U+0100
    c = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at, length = np.arange(len(c)) - np.repeat(first, size), np.repeat(size, size)
    if backwards:
        c = c[np.repeat(first, size) + length - 1 - at]
    most = int(size.max()) + 1
    power, inverse = (np.multiply.accumulate(np.concatenate((_ONE, np.full(most, x, dtype=np.uint64)))) for x in (_B, _INVERSE))
    # a code point weighs by its place in the word; what remains of a word's sum, brought back by
    # the power of its place, hashes the rest alone.  Sums are taken modulo 2^64 over all words.
    term = _LETTER[c] * power[at]
    upto = np.cumsum(term, dtype=np.uint64)
    before = upto - term
    base = np.repeat(before[first], size)
    prefix, whole = before - base, np.repeat(upto[first + size - 1], size) - base
    keep = np.arange(len(c)) if depth is None else first + depth
    if depth is None:
        keep = keep[at >= length // 2]
    if deletions:
        last = at[keep] == length[keep] - 1
        nxt = np.minimum(keep + 1, len(c) - 1)
        ok = last | (c[nxt] != c[keep])
        keep, last, nxt = keep[ok], last[ok], nxt[ok]
        taken = np.where(last, keep - 1, nxt)          # the code point that the trie's edge has
        gone = np.where(last, np.uint64(0), term[keep])
        head = np.where(last, prefix[keep - 1], prefix[keep])
        rest = np.where(last, np.uint64(0), whole[keep] - prefix[keep] - gone - term[taken])
        rest = rest * inverse[at[keep] + 2]
        trie = length[keep] - 1
    else:
        taken, head, trie = keep, prefix[keep], length[keep]
        rest = (whole[keep] - head - term[keep]) * inverse[at[keep] + 1]
    node = mix(head + mix(np.uint64(2) * trie.astype(np.uint64) + np.uint64(backwards)))
    who = np.repeat(np.asarray(ids, dtype=np.int64), size)[keep] * 256 + c[taken]
    return [node.view(np.int64), who, mix(rest).view(np.int64), 2 * at[keep] + int(backwards)]


def _batch(columns, *more):
    names = [f.split()[0] for f in STATES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns] + [pa.array(v) for _, v in more], names=names + [k for k, _ in more])


def _paths(deletions):
    def rows(batches):
        for b in batches:
            words, ids = b.column("word").to_pylist(), b.column("id").to_numpy()
            lo, n = 0, 0
            for i, w in enumerate(words):
                n += len(w)
                if n >= PATH_CHARS or i == len(words) - 1:
                    for backwards in (False, True):
                        yield _batch(_rows(ids[lo:i + 1], words[lo:i + 1], backwards, deletions=deletions))
                    lo, n = i + 1, 0
    return rows


def _follow(batches):
    """Where each state goes on: its edited word's next code point and rest."""
    for b in batches:
        words, meta, to, step = (b.column(c).to_pylist() for c in ("word", "meta", "to", "step"))
        for backwards in (False, True):
            mine = [i for i, m in enumerate(meta) if (m & 1) == backwards]
            if not mine:
                continue
            edited = []
            for i in mine:
                w, q = words[i], meta[i] >> 1
                if backwards:
                    w = w[::-1]
                w = w[:q] + ("" if to[i] < 0 else chr(to[i])) + w[q + 1:]
                edited.append(w[::-1] if backwards else w)
            last = [len(w) - 1 for w in edited]
            depth = np.array([min((meta[i] >> 1) + step[i], z) for i, z in zip(mine, last)], dtype=np.int64)
            out = _rows(b.column("id").to_numpy()[mine], edited, backwards, depth)
            out[3] = np.array([meta[i] for i in mine], dtype=np.int64)
            yield _batch(out, ("to", np.array([to[i] for i in mine], dtype=np.int32)), ("step", np.array([step[i] for i in mine], dtype=np.int32)), ("last", depth == np.array(last)))


_ALIVE = "(n > 1 AND (rests & shiftleft(1L, cast(rest & 63 AS int))) != 0) OR (n = 1 AND only_rest = rest)"


def proposed_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: ids of words that are one edit apart, by hash.  ``words`` has ``id, word``."""
    # the edge table and the words' own paths, both by node
    paths = words.select("id", "word").mapInArrow(_paths(False), STATES).repartition("node")
    code, id_ = F.pmod(F.col("who"), F.lit(256)), F.expr("who div 256").alias("id")
    edges = paths.groupBy("node", code.alias("char")).agg(
        F.count(F.lit(1)).alias("n"), F.min(id_).alias("only"), F.min("rest").alias("only_rest"), F.bit_or(F.expr("shiftleft(1L, cast(rest & 63 AS int))")).alias("rests"))
    edges = stored(edges, "spelling-edges")
    # first edits: a replacement takes another child of the word's node, a larger code point;
    # a deletion the child of the next code point in the trie of the words one shorter
    replaced = paths.join(edges, "node").where(F.col("char") > code).where(_ALIVE)
    replaced = replaced.select(id_, "meta", F.col("char").cast("int").alias("to"), "n", "only")
    gone = words.select("id", "word").mapInArrow(_paths(True), STATES)
    deleted = gone.join(edges, "node").where((F.col("char") >= code) & (F.col("char") <= code)).where(_ALIVE)
    deleted = deleted.select(id_, "meta", F.lit(-1).alias("to"), "n", "only")
    # both kinds have taken one edge from the depth of the edit
    states = stored(replaced.unionByName(deleted).withColumn("step", F.lit(1)), "spelling-states")
    found = states.where("n = 1").select(F.col("id").alias("a"), F.col("only").alias("b"))
    open_ = states.where("n > 1").drop("n", "only")
    while not open_.isEmpty():
        next_ = open_.join(words.select("id", "word"), "id").mapInArrow(_follow, f"{STATES}, to int, step int, last boolean")
        met = next_.join(edges, "node").where((F.col("char") >= code) & (F.col("char") <= code)).where(_ALIVE)
        states = stored(met.select(id_, "meta", "to", (2 * F.col("step")).alias("step"), "only", (F.col("last") | (F.col("n") == 1)).alias("ended")), "spelling-states", narrow=True)
        found = found.unionByName(states.where("ended").select(F.col("id").alias("a"), F.col("only").alias("b")))
        open_ = states.where("not ended").drop("only", "ended")
    return found.distinct()


# ---------------------------------------------------------------- forms and roots

def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = stored(word_counts(docs).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    pairs = proposed_pairs(words)
    a, b = (words.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n")) for k in "ab")
    near = pairs.join(a, "a").join(b, "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    near = stored(near, "spelling-near")
    both = near.select(F.col("a").alias("id"), F.col("b_n").alias("near_n"), F.col("b_word").alias("near")).unionByName(
        near.select(F.col("b").alias("id"), F.col("a_n").alias("near_n"), F.col("a_word").alias("near")))
    best = both.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = F.when(-F.col("best.less") >= FORM_RATIO * F.col("n"), F.col("best.near"))
    forms = words.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
    forms = stored(forms, "spelling-forms")
    # roots by pointer doubling; a form occurs at least FORM_RATIO times as often, so chains are short
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        jump = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(roots.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots", narrow=True)
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
