import collections
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from custlens.llm import gru_lm as G
from custlens.llm import quality_cnn as Q
from custlens.llm.tables import table
from tests.llm.common import clashing, frame, odd_documents

SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_documents(spark):
    labels = table(spark, SF, "labels")
    out = Q.op2(spark, SF).join(labels, "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = out[out.held_out]
    rank = held.score.rank().values
    good = (held.quality == 1).values
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()
    assert auc >= 0.95
    assert held[good].predicted.mean() >= 0.95


def test_gradients_by_differences():
    texts = [b"One two three four.", b"## $$ %% && **" * 20, b"", b"x" * 300]
    laid = Q.lay_out(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)
    net = Q.new_network()
    for p in net.parts():
        p += np.random.default_rng(1).normal(0, 0.05, p.shape).astype(np.float32)

    def loss():
        p = Q._combine(net, laid, Q.pool_blocks(net, laid)[0])[0]
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    for p, g in zip(net.parts(), Q._gradients(net, laid, y, w)):
        flat, grad = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            old, e = flat[i], 2e-3
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - grad[i]) < 0.05 * abs(grad[i]) + 2e-3


def test_a_text_scores_alike_in_any_company():
    texts = ["short", "", "a longer text " * 400, "é" * 2000, "x" * 127, "y" * 128, "z" * 129]
    net = Q.new_network()
    raw = [t.encode() for t in texts]
    together = Q.score(net, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    alone = [Q.score(net, np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert np.allclose(together, alone, atol=1e-5)


def test_classifier_cases(spark):
    docs = clashing(frame(spark, odd_documents()))
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(odd_documents())], "doc_id bigint, quality int, toxic int")
    out = Q.score_documents(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert Q.keep_good(docs, labels).columns == docs.columns
    assert Q.keep_good(docs, labels.limit(0)).count() == docs.count()   # nothing learned: all are kept
    assert Q.score_documents(frame(spark, []), labels).count() == 0


def test_learns_from_long_documents_whole(spark):
    """Every document of label 0 is long: it is learned from, whole, as far as the bytes go."""
    rows = [(i, f"## {i} $$ " * 9000 if i % 2 else f"Document {i} says something plain. " * 20, "en", "s", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(60)], "doc_id bigint, quality int")
    docs = frame(spark, rows + [(1, None, "en", "s", 0)])   # an id with two texts: its least one counts
    texts = {r[0]: r[1].encode() for r in rows} | {1: b""}
    able = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != Q.HELD_OUT]
    got = {r.doc_id: bytes(r.text) for r in Q.training_rows(docs, labels).collect()}
    assert got == {i: texts[i] for i in able}
    few = {r.doc_id: bytes(r.text) for r in Q.training_rows(docs, labels, most_bytes=250_000).collect()}
    assert all(few[i] == texts[i] for i in few)
    long = [i for i in few if i % 2 and len(few[i]) > 32_000]
    assert len(long) == 250_000 // min(len(texts[i]) for i in able if len(texts[i]) > 32_000)
    assert {i for i in few if i % 2 == 0} == {i for i in able if i % 2 == 0}   # the other label has bytes of its own
    scores = {r.doc_id: r.score for r in Q.score_documents(docs, labels).collect() if r.doc_id != 1}
    assert min(scores[i] for i in scores if i % 2 == 0) > max(scores[i] for i in scores if i % 2)


def test_what_no_longer_fits_gives_its_turn_to_the_next():
    assert Q.fitting([(1, 5), (2, 9), (3, 4), (4, 1), (5, 0)], 3, 10) == [1, 3, 4]
    assert Q.fitting([(1, 11), (2, 12)], 3, 10) == [] and Q.fitting([], 3, 10) == []


def test_language_model_base_and_gain(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    out = {r.doc_id: r for r in G.op7(spark, SF).collect()}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = {i: t.encode().translate(low).split() for i, t in rows}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter()
    for i, w in words.items():
        if i not in held:
            c.update(w)
            c[None] += 1
    n, v = sum(c.values()), len(c)
    score = base_sum = 0.0
    for i, w in words.items():
        r = out[i]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)
        assert abs(r.base_score - base) < 1e-9 * abs(base) + 1e-9
        if i in held:
            score, base_sum = score + r.score, base_sum + base
    assert score > 0.95 * base_sum   # both are negative


def tiny_model():
    v = G.Vocabulary(np.arange(10, 40, dtype=np.uint64), np.arange(1, 31)[::-1].copy(), np.minimum(np.arange(30) // 3, G.HEAD_CLASSES - 1), np.ones(G.SHAPES, np.int64), np.ones(G.SHAPES, np.int64), 700, 90, 5)
    return v, G.new_network(v)


def test_language_model_is_a_distribution():
    """The probabilities of all next types sum to 1 after any prefix."""
    v, net = tiny_model()
    prefix = [3, G.HEAD + 2, 7]
    every = [*range(30), *range(G.HEAD, G.TYPES)]
    before = G.network_log10(net, v, np.array(prefix), np.array([0, 3]))[0]
    flat = np.concatenate([[*prefix, t] for t in every])
    after = G.network_log10(net, v, flat, np.arange(0, len(flat) + 1, 4))
    assert abs((10 ** (after - before)).sum() - 1) < 1e-4


def test_language_model_gradients_by_differences():
    """Of all weights, over streams whose documents end, begin and break off inside the window."""
    v, net = tiny_model()
    rng = np.random.default_rng(9)
    for name, p in zip(vars(net), net.parts()):
        setattr(net, name, p.astype(np.float64) + rng.normal(0, 0.1, p.shape))
    e = G.END_TYPE
    window = np.array([[3, 7, G.HEAD + 2, 4, e, 5, 3, 3, e, 9], [1, e, e, 2, 8, 7, G.HEAD + 1, e, -1, -1], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]])
    members = G._members(v)
    place = G._places(members)
    flat, first = [], [0]
    for row in window:
        for t in row[row >= 0]:
            flat.append(t)
            if t == e:
                first.append(len(flat))
        if first[-1] != len(flat):
            first.append(len(flat))

    def loss():
        return -G.network_log10(net, v, np.array(flat), np.array(first)).sum() * np.log(10) / len(flat)

    state = np.zeros((len(window), G.STATE))
    grads, read, last, _ = G._window(net, v, members, place, window, np.full(len(window), e), state)
    assert len(read) == len(flat) and list(last) == [9, e, 9]
    for p, g in zip(net.parts(), grads):
        values, grad = p.reshape(-1), g.reshape(-1)
        assert np.abs(grad).max() > 1e-4
        for i in [*np.argsort(-np.abs(grad))[:6], *rng.choice(np.flatnonzero(grad), 6)]:
            old, step = values[i], 1e-4
            values[i] = old + step
            up = loss()
            values[i] = old - step
            down = loss()
            values[i] = old
            assert abs((up - down) / (2 * step) - grad[i]) < 1e-3 * abs(grad[i]) + 1e-6


def test_state_is_carried_across_windows(monkeypatch):
    v, net = tiny_model()
    rng = np.random.default_rng(5)
    types = np.where(rng.random(500) < 0.8, rng.integers(0, 30, 500), rng.integers(G.HEAD, G.TYPES, 500))
    first = np.array([0, 300, 301, 301, 500])
    whole = G.network_log10(net, v, types, first)
    monkeypatch.setattr(G, "SCORE_STEPS", 7)
    assert np.allclose(whole, G.network_log10(net, v, types, first), atol=1e-3)
    assert whole[2] == 0


def test_training_lowers_the_loss():
    v, _ = tiny_model()
    streams = np.tile(np.array([1, 2, 3, 4, G.HEAD + 1, 5, 6, G.END_TYPE]), (4, 40))
    first = np.arange(0, 321, 8)   # forty equal documents
    before = G.network_log10(G.new_network(v), v, streams[0], first).sum()
    after = G.network_log10(G.train(v, streams, epochs=20), v, streams[0], first).sum()
    assert after > 0.5 * before


def test_language_model_cases(spark):
    rows = odd_documents()
    out = G.score_documents(clashing(frame(spark, rows)))
    assert out.count() == len(rows) and out.where("score is null or base_score is null").count() == 0
    assert out.where("n_tokens = 1").count() >= 4
    assert G.score_documents(frame(spark, [])).count() == 0
    alone = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    nothing = G.score_documents(frame(spark, [(i, "a b", "", "", 0) for i in alone])).collect()
    assert all(r.train_tokens == 0 and r.score == r.base_score == 0 for r in nothing)


def test_network_learns_from_every_document(spark):
    """More than 1200 documents, short and long ones in many partitions: each token is learned from."""
    rows = [(i, f"w{i % 50} x{i % 7} y", "", "", 0) for i in range(1500)] + [(5000 + i, "a b c d " * 10_000, "", "", 0) for i in range(8)]
    docs = G.training_documents(frame(spark, rows).repartition(40)).select("doc_id", "text")
    v = G.vocabulary(G.count_words(docs, 8), docs.count())
    net, tokens = G.learn(G.token_types(docs, spark.sparkContext.broadcast(v)), v, epochs=1)
    assert tokens == v.tokens > 200_000
    assert all(np.isfinite(p).all() for p in net.parts())


def test_network_learns_from_long_documents_alone(spark):
    rows = [(i, "one two three four five six seven eight " * 1000, "", "", 0) for i in range(40)]   # 40 kB each
    out = G.score_documents(frame(spark, rows)).collect()
    assert sum(r.score for r in out) > 0.2 * sum(r.base_score for r in out)   # a word tells the next one


def test_counting_holds_a_piece_of_a_slice(monkeypatch):
    import tracemalloc
    rng = np.random.default_rng(6)
    texts = [" ".join(f"W{i}" for i in rng.integers(0, 2000, 1000)) for _ in range(800)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    h, n, shape = G.counted(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(G, "PIECE_BYTES", 1 << 30)
    for one, whole in zip((h, n, shape), G.counted(batch)):
        assert (one == whole).all()
    assert n.sum() == 800_000 and len(h) == len({w for t in texts for w in t.lower().split()})
    tracemalloc.start()
    G.counted(batch)
    whole_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < whole_peak / 2
