"""Encoding texts unit by unit, for split patterns of the kind ``public_tokenizers.PATTERN``.

Texts are encoded many at a time: each distinct unit is looked up once, and the ids of all texts are gathered
from those of the units.

Such a pattern always has a boundary before a space that a non-space follows, and on both sides
of a lone line break between non-spaces.  A text cut there gives units whose ids, joined, are the
ids of the text; a bounded cache of units then does most of the work.
"""

from __future__ import annotations

import gc
import re
from collections import defaultdict
from itertools import count

import numpy as np
import regex

CACHE_UNITS = 350_000   # of two generations each; about 200 bytes a unit
#: Unicode White_Space, as character class content.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_OTHER_WHITE = "\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # neither space nor \\n
_IRREGULAR = re.compile(f"[ \\n][ \\n]|[{_OTHER_WHITE}]|\\A[ \\n]|[ \\n]\\Z")
_SPACE_THEN_INK = re.compile(f" (?=[^{WHITE}])")
LONGEST_KEY = 64


def splitter(pattern: str):
    """The pattern's ``findall``, with ``\\s`` spelled out as Unicode White_Space."""
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(spelled).findall


def whole_words(pattern: str) -> bool:
    """Whether a word and the space before it are one match."""
    return r"| ?\p{L}+|" in pattern


def irregular(text: str) -> bool:
    """Whether white space other than single spaces and line breaks between ink occurs."""
    return " ".join(text.split()) != text.replace("\n", " ") and _IRREGULAR.search(text) is not None   # split: also at U+001C to U+001F


def cut(text: str) -> list[str]:
    """The units of a text, each with a mark of what stands before it: a tab for the first unit, which the text
    begins with; none for one behind a space; a line break for one behind that alone."""
    if irregular(text):
        return _SPACE_THEN_INK.split("\t" + text)
    return ("\t" + text.replace("\n", " \n")).split(" ")


def unmarked(unit: str) -> str:
    """A unit of ``cut`` as it stands in the text."""
    return unit[1:] if unit[0] == "\t" else unit if unit[0] == "\n" else " " + unit


class Recent(dict):
    """A bounded cache of two generations: the older one is dropped when the newer is full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEY:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


class UnitEncoder:
    """Encodes whole texts; a subclass has ``encode_unit(str) -> bytes`` (ids as little-endian
    unsigned 32-bit integers)."""

    def __init__(self, cache_units: int = CACHE_UNITS):
        self._units = Recent(lambda u: self.encode_unit(unmarked(u)), cache_units)

    def encode_unit(self, unit: str) -> bytes:
        raise NotImplementedError

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units of ``cut``."""
        return list(map(self._units.__getitem__, units))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._units.__getitem__, cut(text))) if text else b""

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and where they begin (and the last one's end); a unit is
        looked up once."""
        collects = gc.isenabled()
        gc.disable()   # no cycles arise here, and searching the caches for them takes long
        try:
            return self._encode_all(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number = defaultdict(count().__next__)   # of a unit: in the order of their first places; holds no reference to itself
        codes, words = [np.zeros(0, dtype=np.int32)], [0]
        for text in texts:
            units = cut(text) if text else ()
            codes.append(np.fromiter(map(number.__getitem__, units), dtype=np.int32, count=len(units)))
            words.append(len(units))
        parts = self.encode_units(list(number))
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        flat, codes = np.frombuffer(b"".join(parts), dtype="<u4"), np.concatenate(codes)
        n = size[codes]
        end = np.concatenate(([0], np.cumsum(n)))
        kind = np.int32 if max(len(flat), end[-1]) < 2**31 else np.int64
        at = np.repeat(((np.cumsum(size) - size)[codes] - end[:-1]).astype(kind), n)
        at += np.arange(end[-1], dtype=kind)
        return flat[at], end[np.cumsum(words)]
