import hashlib

from pyspark.sql import functions as F

from custlens.llm.winnow import K, SPACES, WINDOW, edited_fingerprints, fingerprints
from tests.llm.common import clashing, frame, odd_documents


def test_fingerprints_equal_winnowing(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(odd_documents())]
    df = frame(spark, rows)
    w = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda x: x != ""), lambda x: F.xxhash64(x))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - K, F.lit(0))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get("w", i + j) for j in range(K)]), 32))
    hashes = {r.doc_id: (r.n, r.g) for r in df.select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n"), grams.alias("g")).collect()}
    for r in fingerprints(clashing(df)).collect():
        n, g = hashes[r.doc_id]
        if n < K:
            assert len(r.chosen) == (n > 0)
            continue
        chosen = []
        for i in range(max(1, len(g) - WINDOW + 1)):
            part = g[i:i + WINDOW]
            place = (i + max(j for j, v in enumerate(part) if v == min(part)), min(part))
            if place not in chosen:
                chosen.append(place)
        assert r.fingerprint == " ".join(f"{p}:{h:08x}" for p, h in chosen)


def test_shared_passage_shares_a_position(spark):
    words = [f"w{i}" for i in range(K + WINDOW - 1)]
    rows = [(1, " ".join(["x", "y"] + words + ["z"] * 30), "", "", 0), (2, " ".join(["q"] * 40 + words), "", "", 0)]
    a, b = (dict(reversed(x.split(":")) for x in r.fingerprint.split()) for r in fingerprints(frame(spark, rows)).orderBy("doc_id").collect())
    shared = set(a) & set(b)
    assert shared and all(int(b[h]) - int(a[h]) == 38 for h in shared)


def test_edited_texts_and_likeness(spark):
    rows = [r for r in odd_documents() if r[0] is not None and r[1] != "another text of that id"][:-1]
    rows = list({r[0]: r for r in rows}.values())
    out = {r.doc_id: r for r in edited_fingerprints(clashing(frame(spark, rows).repartition(5))).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    single = {r.doc_id: r.fingerprint for r in fingerprints(frame(spark, rows)).collect()}
    edits = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + nxt[:k]
        edits.append((r[0], edited, "", "", 0))
        o = out[r[0]]
        assert o.n_chars == len(t) and o.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert o.fingerprint == single[r[0]]
        assert o.near_next == likeness(single[r[0]], single[order[(i + 1) % len(order)][0]])
    for r in fingerprints(frame(spark, edits)).collect():
        assert out[r.doc_id].edited_fingerprint == r.fingerprint
        assert out[r.doc_id].near_edited == likeness(single[r.doc_id], r.fingerprint)


def likeness(a, b):
    a, b = ({x.split(":")[1] for x in t.split()} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_odd_tables(spark):
    rows = odd_documents()
    assert edited_fingerprints(frame(spark, rows)).count() == len(rows)
    assert edited_fingerprints(frame(spark, [])).count() == 0
    one = edited_fingerprints(frame(spark, rows[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert edited_fingerprints(frame(spark, [(None, "a b c", "", "", 0), (None, None, "", "", 0)])).count() == 2
