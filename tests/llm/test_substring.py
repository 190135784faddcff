import hashlib
import random

import pyarrow as pa

from custlens.llm import substring as S
from custlens.llm.substring import mark_repeats, op8, remove_repeats
from tests.llm.common import clashing, folder, frame, got, odd_documents, sentence


def removed(rows):
    """By brute force: kept words of every row; rows must not repeat an id with another text."""
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0)):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - S.WINDOW + 1):
            key = tuple(w[k:k + S.WINDOW])
            if key in seen:
                gone[k:k + S.WINDOW] = [True] * S.WINDOW
            seen.add(key)
        out[doc] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return sorted(((r[0], *out[r[0]]) for r in rows), key=repr)


def test_cover_meets_every_difference():
    differences = {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER}
    assert differences == set(range(S.PERIOD)) and S.PERIOD - 1 + S.ANCHOR <= S.WINDOW


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = [r for r in odd_documents() if r[1] != "another text of that id"]
    rng = random.Random(9)
    passages = [sentence(rng, n) for n in (19, 20, 21, 26, 33)]
    for i in range(60):
        rows.append((1000 + i, f"{sentence(rng, rng.randint(0, 15))} {rng.choice(passages)} {sentence(rng, rng.randint(0, 9))}\n{rng.choice(passages)}", "en", "s", 0))
    for size in (1 << 10, 8 << 20):   # copies in one slice, and across slices
        monkeypatch.setattr(S, "SLICE_BYTES", size)
        out = op8(spark, folder(frame(spark, rows).repartition(7), tmp_path / str(size)))
        assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == removed(rows)


def test_removal_keeps_documents_and_columns(spark):
    df = clashing(frame(spark, odd_documents()))
    out = remove_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    before = {(r.doc_id, r.text, r.n_chars) for r in df.collect()}
    marks = {(r.doc_id, r._n_words): r._n_removed for r in mark_repeats(frame(spark, odd_documents())).collect()}
    assert sum(marks.values()) > 0
    for r in out.collect():
        if (r.doc_id, r.text, r.n_chars) not in before and r.text != "":
            assert r.n_chars == len(r.text)


def test_no_documents(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    assert mark_repeats(frame(spark, [(1, None, "", "", 0)]), digest=True).first()._n_words == 0


def test_anchors_are_taken_apart_a_piece_at_a_time(monkeypatch):
    most = 0

    def watched(words, ids, ties, f=S._anchor_entries):
        nonlocal most
        most = max(most, len(ids))
        return f(words, ids, ties)

    rng = random.Random(4)
    rows = [(i, sentence(rng, 40)) for i in range(30)]
    whole = pa.RecordBatch.from_pydict({"_id": [r[0] for r in rows], "_tie": [r[0] for r in rows], "_text": [r[1] for r in rows]})
    monkeypatch.setattr(S, "_anchor_entries", watched)
    monkeypatch.setattr(S, "PIECE_BYTES", 300)
    few = S.anchors_of(whole)
    assert 0 < most < 30
    monkeypatch.setattr(S, "PIECE_BYTES", 1 << 20)
    all_at_once = S.anchors_of(whole)
    assert most == 30 and len(few.h)
    for name in ("h", "h2", "id", "tie", "pos"):
        assert getattr(few, name).tolist() == getattr(all_at_once, name).tolist()
