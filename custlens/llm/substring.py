"""Operator 8: substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document; each word covered by a window whose
word sequence also starts earlier (smaller doc_id, or the same document and an earlier start) is
removed.  Two steps find those windows exactly:

1. Anchors.  Of each document only ``ANCHOR``-word windows at positions whose remainder modulo
   ``PERIOD`` lies in ``COVER`` are hashed.  Every difference modulo ``PERIOD`` is a difference of
   two members of the cover, so two equal windows share an anchor at the same place in both
   (``PERIOD - 1 + ANCHOR <= WINDOW``).  Anchors found twice are sent back to their documents.
2. Extension.  Only windows around such anchors are hashed whole (96 bits); all of equal windows
   but the earliest are sent back, and their words are removed.

Hashes travel as packed arrays, one row per task's slice and hash bucket.  A slice sends one
entry per distinct hash, so a passage that a third of all documents hold is as many entries as
there are slices; further occurrences in the slice are settled there.  Buckets of hashes and of
documents grow in number with the input (``BUCKET_BYTES`` of text), so no task gathers more than a
bounded part.  Texts are shuffled once, by document bucket; both steps reuse that exchange.

Defined cases: a null text has no words; documents shorter than a window lose nothing; null ids
come after all others; rows that repeat doc_id and text are one document (all keep or lose the
same words); rows that repeat a doc_id with another text are ordered by a hash of the text; other
columns are passed on by ``remove_repeats`` and ignored by ``op8``; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from custlens.llm.tables import importable, set_aside, table
from custlens.llm.textscan import GRAM, Words, give_back, grams, scan, slices

WINDOW = 20
ANCHOR = 8
PERIOD = 13
COVER = (0, 1, 3, 9)
SLICE_BYTES = 8 << 20
PIECE_BYTES = 1 << 20   # of text whose words a task takes apart at a time
BUCKET_BYTES = 16 << 20
_LAST_ID = np.int64(2**63 - 1)

_ENTRIES = "bucket bigint, settled boolean, h binary, h2 binary, id binary, tie binary, pos binary"
_REPLIES = "bucket bigint, id binary, tie binary, pos binary"
_ENTRY_TYPES = [pa.int64(), pa.bool_()] + [pa.binary()] * 5
_REPLY_TYPES = [pa.int64()] + [pa.binary()] * 3


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _table(columns: list[list], schema: str, types: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_names(schema))


class Entries:
    """Hashes with the place they belong to: (id, tie) of the document and a word position."""

    def __init__(self, h, h2, id_, tie, pos):
        self.h, self.h2, self.id, self.tie, self.pos = h, h2, id_, tie, pos

    def take(self, at) -> Entries:
        return Entries(self.h[at], self.h2[at], self.id[at], self.tie[at], self.pos[at])

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return Entries(*[np.concatenate([getattr(e, x) for e in parts]) for x in ("h", "h2", "id", "tie", "pos")])

    def ordered(self) -> tuple[Entries, np.ndarray]:
        """By hash, then place; and where a new hash begins."""
        e = self.take(np.lexsort((self.pos, self.tie, self.id, self.h2, self.h)))
        new = np.ones(len(e.h), dtype=bool)
        new[1:] = (e.h[1:] != e.h[:-1]) | (e.h2[1:] != e.h2[:-1])
        return e, new


def _packed(e: Entries, bucket: np.ndarray, settled: bool, wide: bool) -> pa.Table:
    """One row per bucket.  Narrow entries keep 40 bits of the hash (the bucket has others).
    Values lie in document order and by byte planes, which compresses well."""
    order = np.lexsort((e.pos, e.tie, e.id, bucket))
    e, bucket = e.take(order), bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
    if not len(bucket):
        lo = hi = np.zeros(0, dtype=np.int64)
    h = np.zeros((len(e.h), 0), dtype=np.uint8)
    h2 = np.zeros(0, dtype=np.uint32)
    if not settled:
        h = np.ascontiguousarray(e.h.view(np.uint8).reshape(-1, 8)[:, :8 if wide else 5])
        h2 = e.h2 if wide else h2
    return _table([bucket[lo].tolist(), [settled] * len(lo), [h[a:b].tobytes() for a, b in zip(lo, hi)], [h2[a:b].tobytes() for a, b in zip(lo, hi)],
                   *[[_planes(x[a:b]) for a, b in zip(lo, hi)] for x in (e.id, e.tie, e.pos)]], _ENTRIES, _ENTRY_TYPES)


def _replies(id_, tie, pos, buckets: int) -> pa.Table:
    bucket = (tie % np.uint32(buckets)).astype(np.int64)
    order = np.lexsort((pos, tie, id_, bucket))
    id_, tie, pos, bucket = id_[order], tie[order], pos[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
    if not len(bucket):
        lo = hi = np.zeros(0, dtype=np.int64)
    return _table([bucket[lo].tolist(), *[[_planes(x[a:b]) for a, b in zip(lo, hi)] for x in (id_, tie, pos)]], _REPLIES, _REPLY_TYPES)


def _planes(x: np.ndarray) -> bytes:
    """Integers as byte planes: all first bytes, all second bytes, and so on."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=dtype)


def _unplaned(column, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    parts = [np.frombuffer(x.as_py(), np.uint8).reshape(width, -1).T for x in column]
    return np.ascontiguousarray(np.concatenate(parts)).reshape(-1).view(dtype) if parts else np.zeros(0, dtype=dtype)


def _docs(batch) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the texts, and the documents' ids and ties."""
    ids = batch.column("_id").to_numpy() if isinstance(batch, pa.Table) else batch.column("_id").to_numpy(zero_copy_only=False)
    ties = batch.column("_tie").to_numpy() if isinstance(batch, pa.Table) else batch.column("_tie").to_numpy(zero_copy_only=False)
    return scan(batch.column("_text")), ids.astype(np.int64), ties.astype(np.uint32)


def _second(h: np.ndarray, k: int) -> np.ndarray:
    """32 more bits for ``k``-word windows."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        out += (h[j:j + n] ^ (h[j:j + n] >> np.uint64(29))) * GRAM[k + j]
    return (out >> np.uint64(32)).astype(np.uint32)


def _spread(e: Entries, hash_buckets: int, least: bool) -> Iterator[pa.Table]:
    """A slice's entries, one per distinct hash, and those that need no other slice: with
    ``least`` all but the earliest of a hash, else all of a hash that occurs again."""
    e, new = e.ordered()
    if not len(new):
        return
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    if least:
        lead = first[group]
        done = (e.id != e.id[lead]) | (e.tie != e.tie[lead]) | (e.pos != e.pos[lead])
    else:
        done = np.bincount(group)[group] > 1
    one = e.take(first)
    yield _packed(one, ((one.h >> np.uint64(40)) % np.uint64(hash_buckets)).astype(np.int64), False, least)
    done = e.take(done)
    yield _packed(done, np.full(len(done.tie), int(e.tie[0]) % hash_buckets), True, least)


def _gathered(t: pa.Table, buckets: int, least: bool) -> pa.Table:
    """A bucket's entries: the places to send back."""
    settled = t.filter(t.column("settled"))
    open_ = t.filter(pc.invert(t.column("settled")))
    width = 8 if least else 5
    raw = _joined(open_.column("h"), np.uint8).reshape(-1, width)
    h = np.zeros((len(raw), 8), dtype=np.uint8)
    h[:, :width] = raw
    h = h.reshape(-1).view(np.uint64)
    h2 = _joined(open_.column("h2"), np.uint32) if least else np.zeros(len(h), dtype=np.uint32)
    place = [(_unplaned(x.column("id"), np.int64), _unplaned(x.column("tie"), np.uint32), _unplaned(x.column("pos"), np.uint32)) for x in (open_, settled)]
    e, new = Entries(h, h2, *place[0]).ordered()
    if len(new):
        group = np.cumsum(new) - 1
        if least:
            lead = np.flatnonzero(new)[group]
            back = (e.id != e.id[lead]) | (e.tie != e.tie[lead]) | (e.pos != e.pos[lead])
        else:
            back = np.bincount(group)[group] > 1
        e = e.take(back)
    return _replies(*[np.concatenate((a, b)) for a, b in zip((e.id, e.tie, e.pos), place[1])], buckets)


def _anchor_entries(words: Words, ids, ties) -> Entries:
    h = grams(words.hashes(), ANCHOR)
    doc = words.doc()
    pos = np.arange(len(doc)) - words.first[:-1][doc]
    at = np.flatnonzero((doc[:len(h)] == doc[ANCHOR - 1:][:len(h)]) & np.isin(pos[:len(h)] % PERIOD, COVER))
    d = doc[at]
    return Entries(h[at], np.zeros(len(at), dtype=np.uint32), ids[d], ties[d], pos[at].astype(np.uint32))


def anchors_of(b: pa.RecordBatch) -> Entries:
    """Anchors of a batch, whose words are taken apart piece by piece."""
    return Entries.joined([_anchor_entries(*_docs(piece)) for piece in slices([b], "_text", PIECE_BYTES)])


def _marked(words: Words, ids, ties, replies: pa.Table) -> np.ndarray:
    """Word indexes (in the whole table) of the places sent back to these documents."""
    id_, tie, pos = _unplaned(replies.column("id"), np.int64), _unplaned(replies.column("tie"), np.uint32), _unplaned(replies.column("pos"), np.uint32)
    if not len(pos):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((tie, id_))
    id_, tie, pos = id_[order], tie[order], pos[order]
    cuts = np.flatnonzero((np.diff(id_) != 0) | (np.diff(tie.astype(np.int64)) != 0)) + 1
    lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(pos)]))
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(ids.tolist(), ties.tolist())):
        rows.setdefault(key, []).append(i)
    out = [words.first[row] + pos[a:b].astype(np.int64) for a, b in zip(lo, hi) for row in rows.get((int(id_[a]), int(tie[a])), ())]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _window_entries(words: Words, ids, ties, anchors: np.ndarray) -> Entries:
    doc = words.doc()
    n = len(doc)
    near = np.zeros(n + 1, dtype=np.int64)   # windows that begin up to PERIOD - 1 words before an anchor
    first = words.first[:-1][doc[anchors]]
    np.add.at(near, np.maximum(anchors - (PERIOD - 1), first), 1)
    np.add.at(near, anchors + 1, -1)
    starts = np.flatnonzero(np.cumsum(near[:n]) > 0)
    starts = starts[starts + WINDOW <= words.first[1:][doc[starts]]]
    h = words.hashes()
    d = doc[starts]
    return Entries(grams(h, WINDOW)[starts], _second(h, WINDOW)[starts], ids[d], ties[d], (starts - words.first[:-1][d]).astype(np.uint32))


def _covered(words: Words, windows: np.ndarray) -> np.ndarray:
    cover = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(cover, windows, 1)
    np.add.at(cover, windows + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def _keep(words: Words, gone: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Each text without its removed words and the white space after them; words removed."""
    data = words.data.tobytes()
    texts, removed = [], []
    for i in range(len(words.first) - 1):
        a, b = int(words.first[i]), int(words.first[i + 1])
        lo, hi = int(words.offsets[i]), int(words.offsets[i + 1])
        out = gone[a:b]
        n = int(out.sum())
        removed.append(n)
        if not n:
            texts.append(data[lo:hi])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
        parts, at = [], lo
        for s, e in zip(edge[::2], edge[1::2]):
            parts.append(data[at:int(words.start[a + s])])
            at = int(words.start[a + e]) if a + e < b else hi
        texts.append(b"".join(parts) + data[at:hi])
    return texts, removed


def mark_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its repeated words, and columns ``_n_words``, ``_n_removed``
    (and with ``digest`` ``_kept_sha256``: of the kept words joined by one space)."""
    spark = docs.sparkSession
    importable(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hash_buckets = max(partitions, size // BUCKET_BYTES)
    buckets = 2 * hash_buckets
    hashed = F.xxhash64(F.coalesce("text", F.lit("")), "doc_id").bitwiseAND(F.lit(0xFFFFFFFF))
    rows = docs.withColumns({"_text": F.coalesce(F.col("text"), F.lit("")), "_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_LAST_ID))), "_tie": hashed}).drop("text")
    rows = rows.withColumn("_bucket", F.col("_tie") % F.lit(buckets))
    keyed = rows.groupBy("_bucket")

    def anchors(batches):
        for b in slices(batches, "_text", SLICE_BYTES):
            for t in _spread(anchors_of(b), hash_buckets, False):
                yield from t.to_batches()
            give_back()

    def windows(_, d, r):
        give_back()
        found = []
        if d.num_rows and r.num_rows:
            words, ids, ties = _docs(d)
            at = np.unique(_marked(words, ids, ties, r))
            found = list(_spread(_window_entries(words, ids, ties, at), hash_buckets, True))
        return pa.concat_tables(found) if found else _table([[]] * 7, _ENTRIES, _ENTRY_TYPES)

    kept_names = [f.name for f in rows.schema if f.name not in ("_text", "_id", "_tie", "_bucket")]

    def cut(_, d, r):
        give_back()
        words, ids, ties = _docs(d)
        gone = _covered(words, _marked(words, ids, ties, r))
        texts, removed = _keep(words, gone)
        t = d.select(kept_names).append_column("text", pa.array(texts, pa.binary()).cast(pa.string()))
        t = t.append_column("_n_words", pa.array(words.n_words, pa.int64())).append_column("_n_removed", pa.array(removed, pa.int64()))
        if digest:
            t = t.append_column("_kept_sha256", pa.array([hashlib.sha256(b" ".join(x.split())).hexdigest() for x in texts], pa.string()))
        return t

    out = StructType([f for f in rows.schema if f.name in kept_names] + [docs.schema["text"], StructField("_n_words", LongType()), StructField("_n_removed", LongType())])
    if digest:
        out = out.add("_kept_sha256", "string")

    def gather(entries: DataFrame, least: bool) -> DataFrame:
        return entries.groupBy("bucket").applyInArrow(lambda t: _gathered(t, buckets, least), _REPLIES)

    hit = gather(rows.select("_text", "_id", "_tie").mapInArrow(anchors, _ENTRIES), False)
    again = gather(keyed.cogroup(hit.groupBy("bucket")).applyInArrow(windows, _ENTRIES), True)
    return keyed.cogroup(again.groupBy("bucket")).applyInArrow(cut, out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words removed from ``text`` (and ``n_chars`` as it then is)."""
    rows, back = set_aside(docs)
    out = mark_repeats(rows)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"))
