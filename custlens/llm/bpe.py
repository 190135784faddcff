"""Operator 3: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token (a match of the split pattern) is merged on a linked list of its bytes.  Pending
merges wait in buckets, one per merge rank; a bucket is a heap of the list positions whose pair
has that rank.  A two-level bitmap (a root whose bits name non-empty leaves, leaves whose bits
name non-empty ranks) gives the next rank by find-first-set.  Entries whose pair has changed
meanwhile are skipped when popped.  A merge costs a constant number of bitmap and heap steps, so
a pre-token of n bytes takes O(n log n) however long it is.

Distinct pre-tokens of a slice of texts that are not cached are merged together in one such queue
(``BatchQueue``), whose buckets are arrays of positions; only long ones have a queue of their own.

Texts are cut at places where the pattern always has a boundary (before a space that a
non-space follows, and around a lone line break); each cut unit's ids are cached, with a bound
on the cache.  Cutting there and caching change no id: a test compares with tiktoken.

Defined cases: a null text counts as empty; an empty text has no ids, and both digests are those
of no bytes; repeated rows give repeated results; columns besides ``doc_id`` and ``text`` are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.textscan import gathered
from custlens.llm.units import CACHE_UNITS, Recent, UnitEncoder, cut, splitter, unmarked, whole_words

LEAF_BITS = 8        # a bitmap leaf covers 2 ** LEAF_BITS ranks
LEAF_MASK = (1 << LEAF_BITS) - 1
LONG_UNIT = 60       # characters; longer units' pre-tokens have a queue of their own
QUEUE_PIECES = 400_000
SLICE_BYTES = 16 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines()) if t}


class BatchQueue:
    """The same queue over many pre-tokens at once: one linked list with a barrier after each, and
    buckets that hold positions of all of them.

    The next rank's positions are merged together, of each pre-token the leftmost one (further ones
    wait again: a merge may make a lower rank beside it), so every pre-token sees its merges in the order
    of (rank, position), as alone."""

    def __init__(self, ranks: dict[bytes, int], pair: list[list[int]]):
        self.first = np.array([ranks.get(bytes((x,)), -1) for x in range(256)], dtype=np.int32)
        self.pair = np.array(pair, dtype=np.int32)
        self.size = max(ranks.values(), default=-1) + 1
        # (left token, right token) -> token, for every way to cut a token into two tokens
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys, self.values = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int32)[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every pre-token (not empty), as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        end = np.cumsum(size)
        n = len(data)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        token = self.first[data]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)   # of at most QUEUE_PIECES short pieces
        nxt[end - 1] = -1                # barriers
        prv[end - size] = -1
        alive = np.ones(n, dtype=bool)
        at = np.full(n, -1, dtype=np.int32)
        inner = np.flatnonzero(nxt >= 0)
        at[inner] = self.pair[data[inner], data[inner + 1]]
        bucket: dict[int, list[np.ndarray]] = {}
        leaves = [0] * ((self.size >> LEAF_BITS) + 1)
        root = 0

        def push(places, ranks):
            nonlocal root
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for rank, lo, hi in zip(ranks[begins].tolist(), begins, [*begins[1:], len(ranks)]):
                if rank in bucket:
                    bucket[rank].append(places[lo:hi])
                else:
                    bucket[rank] = [places[lo:hi]]
                    leaf = rank >> LEAF_BITS
                    leaves[leaf] |= 1 << (rank & LEAF_MASK)
                    root |= 1 << leaf

        some = np.flatnonzero(at >= 0)
        if len(some):
            push(some, at[some])
        while root:
            leaf = (root & -root).bit_length() - 1
            bits = leaves[leaf]
            low = bits & -bits
            rank = (leaf << LEAF_BITS) + low.bit_length() - 1
            waiting = bucket.pop(rank)
            leaves[leaf] = bits = bits ^ low
            if not bits:
                root &= root - 1
            i = waiting[0] if len(waiting) == 1 else np.unique(np.concatenate(waiting))
            i = i[at[i] == rank]         # others are stale
            if not len(i):
                continue
            if len(i) > 1:
                again = piece[i[1:]] == piece[i[:-1]]
                if again.any():
                    later = np.concatenate(([False], again))
                    push(i[later], at[i[later]])
                    i = i[~later]
            j = nxt[i]
            after = nxt[j]
            token[i] = rank
            nxt[i] = after
            alive[j] = False
            at[j] = -1
            more = after >= 0
            prv[after[more]] = i[more]
            new = np.full(len(i), -1, dtype=np.int32)
            new[more] = self._rank(token[i[more]], token[after[more]])
            at[i] = new
            before = prv[i]
            has = before >= 0
            left = before[has]
            new_left = self._rank(token[left], token[i[has]])
            at[left] = new_left
            places, ranks = np.concatenate((i, left)), np.concatenate((new, new_left))
            ok = ranks >= 0
            if ok.any():
                push(places[ok], ranks[ok])
        ids = token[alive].astype("<u4").tobytes()
        stop = 4 * np.cumsum(np.bincount(piece[alive], minlength=len(pieces)))
        stop = stop.tolist()
        return [ids[a:b] for a, b in zip([0, *stop], stop)]


class BytePairCodec(UnitEncoder):
    """Encoder and decoder for a rank file, whose pattern splits the text first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_units: int = CACHE_UNITS):
        super().__init__(cache_units)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pair = [[ranks.get(bytes((x, y)), -1) for y in range(256)] for x in range(256)]
        self.split = splitter(pattern)
        self.whole_words = whole_words(pattern)
        self._piece = Recent(self._encode_piece, cache_units // 2)
        self.queue = BatchQueue(ranks, self.pair)

    def prepare(self, texts: list[str]) -> None:
        """Fill the caches with the units of ``texts``."""
        self.encode_units(list({u for text in texts if text for u in cut(text)}))

    def encode_units(self, units: list[str]) -> list[bytes]:
        """As from the caches, whose new units' pre-tokens are merged in one queue; long units are encoded one by one."""
        split, whole, known, cached = self.split, self.ranks.get, self._units, self._piece
        out, new = [], []
        for i, u in enumerate(units):
            ids = known.get(u)
            if ids is None:
                ids = known.old.get(u)
                if ids is None:
                    new.append(i)
                else:
                    known.put(u, ids)
            out.append(ids)
        ids: dict[str, bytes | None] = {}   # of new units' pre-tokens
        waiting, raws, several, counts, flat = [], [], [], [], []
        for i in new:
            u = units[i]
            if len(u) > LONG_UNIT:
                out[i] = known[u]
                continue
            if self.whole_words and u.isascii() and u.isalpha():   # one pre-token, that no other unit has
                raw = b" " + u.encode()
                rank = whole(raw)
                if rank is None:
                    waiting.append(i)
                    raws.append(raw)
                else:
                    out[i] = rank.to_bytes(4, "little")
                continue
            pieces = split(unmarked(u))
            several.append(i)
            counts.append(len(pieces))
            flat += pieces
            for p in pieces:
                if p not in ids:
                    ids[p] = cached.get(p) or cached.old.get(p)
        alone, asked = len(waiting), []
        for p, found in ids.items():
            if found is None:
                raw = p.encode()
                rank = whole(raw)
                if rank is None:
                    asked.append(p)
                    raws.append(raw)
                else:
                    ids[p] = rank.to_bytes(4, "little")
        waiting += asked
        for lo in range(0, len(waiting), QUEUE_PIECES):
            for at, merged in enumerate(self.queue.merge(raws[lo:lo + QUEUE_PIECES]), lo):
                if at < alone:
                    out[waiting[at]] = merged
                else:
                    ids[waiting[at]] = merged
                    cached.put(waiting[at], merged)
        at = 0
        for i, n in zip(several, counts):
            out[i] = ids[flat[at]] if n == 1 else b"".join([ids[p] for p in flat[at:at + n]])
            at += n
        for i in new:
            if len(units[i]) <= LONG_UNIT:
                known.put(units[i], out[i])
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        nxt = list(range(1, n + 2))
        prv = list(range(-1, n))
        pair = self.pair
        at = [pair[x][y] for x, y in zip(piece, piece[1:])]   # rank of the pair that begins here
        at += (-1, -1)
        bucket: dict[int, list[int]] = {}
        leaves: dict[int, int] = {}
        root = 0
        for i, rank in enumerate(at):
            if rank < 0:
                continue
            if rank in bucket:
                bucket[rank].append(i)
            else:
                bucket[rank] = [i]
                leaf = rank >> LEAF_BITS
                leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & LEAF_MASK)
                root |= 1 << leaf
        while root:
            leaf = (root & -root).bit_length() - 1
            bits = leaves[leaf]
            low = bits & -bits
            rank = (leaf << LEAF_BITS) + low.bit_length() - 1
            waiting = bucket[rank]
            if len(waiting) == 1:
                i = waiting[0]
                del bucket[rank]
                leaves[leaf] = bits = bits ^ low
                if not bits:
                    root &= root - 1
            else:
                i = heappop(waiting)
            if at[i] != rank:        # stale
                continue
            j = nxt[i]
            end = nxt[j]
            nxt[i] = end
            prv[end] = i
            at[j] = -1
            before = prv[i]
            for left, stop in ((i, nxt[end] if end < n else 0), (before, end if before >= 0 else 0)):
                if not stop:
                    if left >= 0:
                        at[left] = -1
                    continue
                new = ranks.get(piece[left:stop])
                if new is None:
                    at[left] = -1
                    continue
                at[left] = new
                if new in bucket:
                    heappush(bucket[new], left)
                else:
                    bucket[new] = [left]
                    leaf = new >> LEAF_BITS
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (new & LEAF_MASK)
                    root |= 1 << leaf
        out, i = [], 0
        while i < n:
            j = nxt[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def _encode_piece(self, piece: str) -> bytes:
        return array("I", self.merge(piece.encode())).tobytes()

    def encode_unit(self, unit: str) -> bytes:
        piece = self._piece
        return b"".join([piece[p] for p in self.split(unit)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


_CODECS: dict[str, BytePairCodec] = {}


def codec(raw: bytes, pattern: str) -> BytePairCodec:
    """The codec of a rank file, built once per Python worker."""
    key = hashlib.sha1(raw + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(read_ranks(raw), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: its number of ids, the digests of its ids and of their decoding,
    and with ``keep_ids`` the ids themselves (little-endian unsigned 32-bit integers).

    The rank file is read on the driver and broadcast: its size is that of a vocabulary.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches):
        c = codec(raw.value, pattern)
        sha = hashlib.sha256
        for b in gathered(batches, "text", SLICE_BYTES):
            n, ids_sha, back_sha, kept = [], [], [], []
            all_ids, first = c.encode_all(b.column("text").to_pylist())
            for lo, hi in pairwise(first.tolist()):
                ids = all_ids[lo:hi].tobytes()
                n.append(hi - lo)
                ids_sha.append(sha(ids).hexdigest())
                back_sha.append(sha(c.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield from pa.Table.from_arrays(cols, names=names).combine_chunks().to_batches()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from custlens.llm.tables import table
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
