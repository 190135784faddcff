"""Operator 6: hierarchical multi-length packing.

A document's ids (with the end id) are cut into full longest windows and a rest.  Rests are
routed to context-size tiers (the shortest window that holds them) and every tier is packed:
a window takes a rest, its gap takes the longest shorter pieces that fit whole, and when none
fits, the front of the shortest longer piece.  So every window is exactly full, whatever its
tier; only the last one of a task's documents can be padded.  Windows of one tier are grouped
into steps of equal token volume; a step's windows are held until it is full (at most one step a
tier), and what is left of the tiers at the end goes to as few steps as hold it, the longest windows
first, each to the step with the least volume.

The work is one pass over the documents where they are read: no shuffle.  A task packs blocks
of ``BLOCK_TOKENS`` ids, so its memory is bounded by a block and the longest document; what does
not fill a window goes over to the next block.  Ids of sequences and steps carry the
partition's number, so a task that runs again on another executor gives the same ids.

Defined cases: a null or empty text is the end id alone; repeated rows and ids are packed as
separate documents; special tokens' strings in a text are ordinary text; columns besides
``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappush, heapreplace
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.textscan import give_back, slices
from custlens.llm.units import CACHE_UNITS, LONGEST_KEY, Recent, UnitEncoder, splitter, unmarked, whole_words

WINDOW = 2048
TIERS = (128, 256, 512, 1024, 2048)
STEP_TOKENS = 16 * 2048
BLOCK_TOKENS = 1 << 20
END_ID = 1
SLICE_BYTES = 2 << 20   # of text encoded at a time
END_MARKS = ".,;:!?)"
PIECES = 50_000   # pre-tokens whose ids are kept, of two generations each

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, tier int, step_id bigint")


class TokenizerUnits(UnitEncoder):
    """Ids by the tokenizers library: its pre-tokens (the split pattern, mapped to byte symbols)
    through the BPE model of the file."""

    def __init__(self, raw: bytes, pattern: str, cache_units: int = CACHE_UNITS):
        super().__init__(cache_units)
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_buffer(raw)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.split = splitter(pattern)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]   # bytes that are their own symbol
        self.symbols = dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.space = " ".translate(self.symbols)
        self.whole_words = whole_words(pattern)
        self._piece = Recent(self._encode_piece, PIECES)

    def _encode_piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.symbols))]).tobytes()

    def encode_unit(self, unit: str) -> bytes:
        word = unit[1:] if unit.startswith(" ") else unit
        if self.whole_words and word.isascii() and word.isalpha():   # one pre-token, whose letters are their own symbols
            return array("I", [t.id for t in self.tokenize(self.space + word if word is not unit else word)]).tobytes()
        pieces, cached = self.split(unit), self._piece
        if len(pieces) == 1:   # kept as a unit
            return self._encode_piece(unit)
        return b"".join([cached[p] for p in pieces])

    def encode_units(self, units: list[str]) -> list[bytes]:
        known, cached, tokenize, space, out = self._units, self._piece, self.tokenize, self.space, []
        for u in units:
            ids = known.get(u)
            if ids is None:
                ids = known.old.get(u)
                if ids is None:
                    word = u[:-1] if u[-1] in END_MARKS else u   # a mark after a letter is a match of its own
                    if self.whole_words and word.isascii() and word.isalpha():   # as in encode_unit
                        ids = known.get(word) if word is not u else None
                        if ids is None:
                            ids = array("I", [t.id for t in tokenize(space + word)]).tobytes()
                        if word is not u:
                            ids += cached[u[-1]]
                    else:
                        ids = self.encode_unit(unmarked(u))
                if len(u) <= LONGEST_KEY:
                    known.put(u, ids)
            out.append(ids)
        return out


_ENCODERS: dict[str, TokenizerUnits] = {}


def encoder(raw: bytes, pattern: str, cache_units: int = CACHE_UNITS) -> TokenizerUnits:
    """The encoder of a tokenizer file, built once per Python worker."""
    key = f"{zlib.crc32(raw)} {cache_units} {pattern}"
    if key not in _ENCODERS:
        _ENCODERS[key] = TokenizerUnits(raw, pattern, cache_units)
    return _ENCODERS[key]


class TierPacker:
    """Packs pieces ``(doc, start, ids, doc_tokens)``, ids being bytes of 32-bit integers."""

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers)
        self.window = self.tiers[-1]
        self.pool: dict[int, list] = {}
        self.mask = 0   # bit n: the pool has a piece of n ids

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, list]]:
        """Takes a document; yields its full longest windows as (tier, pieces)."""
        total, step = len(ids) // 4, self.window
        whole = total // step * step
        for s in range(0, whole, step):
            yield step, [(doc, s, ids[4 * s:4 * (s + step)], total)]
        if total > whole:
            self._push((doc, whole, ids[4 * whole:], total))

    def _push(self, piece) -> None:
        n = len(piece[2]) // 4
        self.pool.setdefault(n, []).append(piece)
        self.mask |= 1 << n

    def _pop(self, n: int):
        waiting = self.pool[n]
        piece = waiting.pop()
        if not waiting:
            self.mask ^= 1 << n
        return piece

    def pack(self) -> Iterator[tuple[int, list]]:
        """Yields full windows as (tier, pieces); pieces that fill no window stay."""
        while self.mask:
            longest = self.mask.bit_length() - 1
            content = [self._pop(longest)]
            tier = self.tiers[bisect_left(self.tiers, longest)]
            gap = tier - longest
            while gap and self.mask:
                fits = (self.mask & ((2 << gap) - 1)).bit_length() - 1
                if fits > 0:
                    content.append(self._pop(fits))
                    gap -= fits
                    continue
                above = self.mask >> gap
                doc, start, ids, total = self._pop((above & -above).bit_length() - 1 + gap)
                content.append((doc, start, ids[:4 * gap], total))
                self._push((doc, start + gap, ids[4 * gap:], total))
                gap = 0
            if gap:
                for piece in content:
                    self._push(piece)
                return
            yield tier, content

    def rest(self) -> list:
        """The pieces that are left: fewer ids than the longest window."""
        out = [p for n in sorted(self.pool, reverse=True) for p in self.pool[n]]
        self.pool, self.mask = {}, 0
        return out


def balanced(windows: list[tuple], volume: int) -> list[list[tuple]]:
    """Windows (length first) in as few steps of at most ``volume`` as lengths that divide each other
    and ``volume`` allow, the steps' volumes as equal as can be."""
    n = -(-sum(w[0] for w in windows) // volume)
    steps = [(0, i, []) for i in range(n)]   # a heap of (volume, number, windows)
    for w in sorted(windows, key=lambda w: -w[0]):
        if steps[0][0] and steps[0][0] + w[0] > volume:   # lengths that do not divide the volume
            heappush(steps, (0, len(steps), []))
        filled, i, step = steps[0]
        step.append(w)
        heapreplace(steps, (filled + w[0], i, step))
    return [step for _, _, step in sorted(steps, key=lambda s: s[1]) if step]


def pack_documents(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int = END_ID, tiers=TIERS, step_tokens: int = STEP_TOKENS, block_tokens: int = BLOCK_TOKENS, cache_units: int = CACHE_UNITS) -> DataFrame:
    """One row per piece: whose ids, where in the document, in which sequence and at what offset.
    ``cache_units``: units whose ids a worker keeps, for speed only.

    The tokenizer's file is read on the driver and broadcast (its size is that of a vocabulary).
    """
    with open(tokenizer_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    end = array("I", [end_id]).tobytes()

    def run(batches):
        give_back()
        encode_all, packer = encoder(raw.value, pattern, cache_units).encode_all, TierPacker(tiers)
        base = TaskContext.get().partitionId() << 33
        sequences = 0
        steps = 0
        held: dict[int, list] = {}   # tier: the windows of its open step
        out: list[list] = [[] for _ in range(9)]

        def close(windows: list) -> None:
            nonlocal steps
            for tier, sequence, pieces in windows:
                at = 0
                for doc, start, ids, total in pieces:
                    n = len(ids) // 4
                    for col, v in zip(out, (doc, start, n, zlib.crc32(ids), total, sequence, at, tier, base + steps)):
                        col.append(v)
                    at += n
            steps += 1

        def place(tier: int, pieces: list) -> None:
            nonlocal sequences
            step = held.setdefault(tier, [])
            step.append((tier, base + sequences, pieces))
            sequences += 1
            if (len(step) + 1) * tier > step_tokens:
                close(held.pop(tier))

        def rows() -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            for c in out:
                c.clear()
            return batch

        block = 0
        for b in slices(batches, "text", SLICE_BYTES):
            all_ids, first = encode_all(b.column("text").to_pylist())
            for doc, (lo, hi) in zip(b.column("doc_id").to_pylist(), pairwise(first.tolist())):
                ids = all_ids[lo:hi].tobytes() + end
                block += hi - lo + 1
                for tier, pieces in packer.add(doc, ids):
                    place(tier, pieces)
                if block >= block_tokens:
                    for tier, pieces in packer.pack():
                        place(tier, pieces)
                    block = 0
                    yield rows()
                    give_back()
        for tier, pieces in packer.pack():
            place(tier, pieces)
        left = packer.rest()
        if left:
            place(packer.window, left)
        for windows in balanced([w for step in held.values() for w in step], step_tokens):
            close(windows)
        yield rows()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from custlens.llm.tables import table
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
