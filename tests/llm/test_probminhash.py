import random

import numpy as np
import pyarrow as pa

from custlens.llm.probminhash import band_keys, components, keep_one, near_classes, prefixes, shingles, signatures
from custlens.llm.textscan import scan
from tests.llm.common import clashing, frame, got, odd_documents, sentence


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    texts = sorted({r[1] or "" for r in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sets = {t: shingle_set(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    names = {}
    for r in rows:
        if r[0] is not None:
            c = find(r[1] or "")
            names[c] = min(names.get(c, r[0]), r[0])
    return sorted(((r[0], names.get(find(r[1] or ""))) for r in rows), key=repr)


def near_rows():
    rng = random.Random(6)
    rows = odd_documents()
    for c in range(6):   # groups of near copies; chains whose ends are not links
        words = sentence(rng, 60 + 40 * c).split()
        for i in range(12):
            if i % 3 == 0:
                words[rng.randrange(len(words))] = f"edit{c}x{i}"
            rows.append((5000 + 100 * c + i, " ".join(words), "en", "s", 0))
    passage = sentence(rng, 40)   # a common passage makes buckets of texts that are no links
    rows += [(7000 + i, f"{passage} {sentence(rng, rng.randint(4, 40))}", "en", "s", 0) for i in range(40)]
    return rows


def test_classes_equal_brute_force(spark):
    rows = near_rows()
    assert got(near_classes(clashing(frame(spark, rows))), "doc_id", "class_id") == brute(rows)


def test_keep_one_of_each_class(spark):
    rows = near_rows()
    df = clashing(frame(spark, rows))
    out = keep_one(df)
    assert out.columns == df.columns
    classes = brute(rows)
    # the text without an id is a class of its own, and so are both texts of the id that has two
    assert out.count() == len({c for _, c in classes if c is not None}) + 2
    kept = {r.doc_id for r in out.collect() if r.doc_id is not None}
    assert kept == {c for _, c in classes if c is not None}


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**62, 1200).astype(np.uint64)
    weight = rng.integers(1, 5, 1200).astype(float)
    a, b = slice(0, 900), slice(300, 1200)
    doc = np.concatenate((np.zeros(900, int), np.ones(900, int)))
    held = signatures(doc, np.concatenate((base[a], base[b])), np.concatenate((weight[a], weight[b])), 2, registers=4096)
    wa, wb = np.zeros(1200), np.zeros(1200)
    wa[a], wb[b] = weight[a], weight[b]
    both = (wa > 0) & (wb > 0)
    exact = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in np.flatnonzero(both))
    assert abs((held[0] == held[1]).mean() - exact) < 0.03
    scaled = signatures(np.zeros(900, int), base[a], weight[a] * 1.0, 1)
    assert (band_keys(scaled) == band_keys(signatures(np.zeros(900, int), base[a], weight[a], 1))).all()


def test_shingles_of_short_texts():
    words = scan(pa.array(["a b", "a b", "a b c d e", None, "", "b a"]))
    d, g, n = shingles(words)
    assert d.tolist() == [0, 1, 2, 5] and g[0] == g[1] != g[3] and n.tolist() == [1, 1, 1, 1]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 101)], "a bigint, b bigint")
    out = {r.node: r["class"] for r in components(edges).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 100}


def many_edits(n=60):
    """Copies of one text with more and more edits: some are links, many are none, and they fill the same buckets."""
    rng = random.Random(11)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(i % 6):
            words[rng.randrange(150)] = rng.choice(["edit", "other", f"own{i}"])
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows


def test_copies_with_many_edits(spark):
    rows = many_edits()
    assert 3 < len({c for _, c in brute(rows)}) < 40
    assert got(near_classes(frame(spark, rows)), "doc_id", "class_id") == brute(rows)


def test_prefixes_hold_a_shingle_of_every_link(spark):
    rows = many_edits()
    texts = sorted({r[1] for r in rows})
    sets = [shingle_set(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    held = {i: {} for i in range(len(texts))}
    for r in prefixes(df).collect():
        assert r.size == len(sets[r.node]) and 0 <= r.place <= r.size - 0.8 * r.size
        held[r.node][r.key] = r.place
    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                links += 1
                k = min(held[i].keys() & held[j].keys(), key=lambda k: held[i][k])
                assert len(a & b) <= min(len(a) - held[i][k], len(b) - held[j][k])
    assert links > 20


def test_no_documents(spark):
    assert near_classes(frame(spark, [])).count() == 0
    assert keep_one(frame(spark, [])).count() == 0
    assert near_classes(frame(spark, [(1, None, "", "", 0), (2, "", "", "", 0)])).select("class_id").distinct().count() == 1


def test_links_between_texts_that_repeat_a_passage_unequally(spark):
    rng = random.Random(8)
    rows = []
    for i in range(12):   # set similarity 0.97, the passage once in one text and 300 times in the other
        words = sentence(rng, 140).split()
        rows += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(words + words[-20:] * 300), "en", "s", 0)]
    assert set(brute(rows)) == {(i, i - i % 2) for i in range(24)}
    assert got(near_classes(frame(spark, rows)), "doc_id", "class_id") == brute(rows)
