import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from custlens.llm import spelling as S
from tests.llm.common import clashing, folder, frame, odd_documents


def low(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def brute(rows):
    n = {}
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                n[w] = n.get(w, 0) + 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: set() for w in n}
    by_gap = {}
    for w in n:
        for i in range(len(w)):
            by_gap.setdefault((w[:i], w[i + 1:]), []).append(w)
    for same in by_gap.values():
        for w in same:
            near[w] |= set(same) - {w}
    for w in n:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in n:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def edited(rng, w):
    i, c = rng.randrange(len(w) + 1), rng.choice("aeéÿxzÀ")
    kind = rng.randrange(3)
    return w[:i] + c + w[i:] if kind == 0 else w[:i] + w[i + 1:] if kind == 1 else w[:i] + c + w[i + 1:]


def variant_rows(seed=4, n_docs=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "aa", "É", "ie"]) for _ in range(rng.randint(3, 7))) for _ in range(30)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab", "Straße" * 2, "x" * 300, "x" * 299 + "y", "x" * 301]
    pool = words * 30 + [edited(rng, w) for w in words for _ in range(12)]
    pool += [edited(rng, edited(rng, w)) for w in words for _ in range(6)]
    pool += pool[-300:]
    chain = "kettlebase " * 1200 + "kettlebasf " * 80 + "kettlxbasf " * 4
    return [(n_docs, chain, "en", "s", 0)] + [(i, " ".join(rng.choice(pool) for _ in range(120)) + rng.choice([".", "1", "Ÿabcdefg", "×", "日本"]), "en", "s", 0) for i in range(n_docs)]


def test_equals_brute_force(spark):
    rows = variant_rows()
    want = brute(rows)
    assert got(S.variants(frame(spark, rows).repartition(4))) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[1] != r[2] for r in want)


def test_long_walks(spark):
    """Words with long common parts: walks of many edges, from both ends."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh") for _ in range(60))
    words = {base} | {edited(rng, base) for _ in range(80)}
    words |= {edited(rng, w) for w in list(words)[:60]}
    rows = [(i, " ".join(sorted(words)), "", "", 0) for i in range(3)]
    assert got(S.variants(frame(spark, rows))) == brute(rows)


def test_odd_documents(spark, tmp_path):
    rows = odd_documents() + [(7, "A" * 9000 + " " + "a" * 9000 + " " + 2 * ("a" * 4000 + "b" + "a" * 4999 + " "), "", "", 0), (-5, "Wörterbuch wörterbuch WÖRTERBUCH Wrterbuch wrterbuch", None, None, None)] * 2
    df = frame(spark, rows)
    assert got(S.variants(clashing(df))) == brute(rows)
    assert got(S.op11(spark, folder(df, tmp_path))) == brute(rows)
    assert got(S.variants(frame(spark, []))) == []
    assert got(S.variants(frame(spark, [(1, None, "", "", 0), (2, "short words only", "", "", 0)]))) == []


def test_checksums():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    size = np.array([1, 2, 63, 64, 65, 66, 700, 7, 7, 1])
    start = rng.integers(0, 4000, len(size))
    state = rng.integers(0, 2**32, len(size), dtype=np.uint32)
    want = [zlib.crc32(data[s:s + n].tobytes(), int(c)) for s, n, c in zip(start, size, state)]
    assert S._checksums(data, start, size, state).tolist() == want
