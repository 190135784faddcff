import gc
import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from custlens.llm.bpe import BytePairCodec, encode_documents, read_ranks
from custlens.llm.packing import TIERS, TokenizerUnits, pack_documents
from tests.llm.common import frame, odd_documents

RANKS, VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
HARD = ["", " ", "\n", " a", "a  b", "a \n b", "a\n\nb", "a\x1cb \x85c", "'s 'S don't", "thethe" * 400, "\n" * 50 + "x", " " * 33, "\U0001f600" * 90, "12 3４ ²", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(open(RANKS, "rb").read())


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice("ab \n\t'é中1\x1c\x85! sll") for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_encoding_equals_tiktoken(ranks):
    own = BytePairCodec(ranks, P.PATTERN, cache_units=64)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in HARD + random_texts(3000):
        ids = own.encode(text)
        assert list(array("I", ids)) == other.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_merge_order_for_ranks_out_of_order():
    """A merged pair's rank may be lower than its parts': the queue must go back."""
    ranks = {bytes([b]): 300 + b for b in range(256)} | {b"ab": 20, b"abc": 5, b"ca": 10, b"aab": 1, b"aa": 30}
    own = BytePairCodec(ranks, P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert list(array("I", own.encode(text))) == other.encode_ordinary(text)


def test_op3_rows(spark, ranks):
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd_documents()
    out = encode_documents(frame(spark, rows), RANKS, P.PATTERN).collect()
    expected = []
    for r in rows:
        ids = other.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)
    assert encode_documents(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_units_equal_the_tokenizers_library():
    own = TokenizerUnits(open(VOCABULARY, "rb").read(), P.PATTERN)
    other = Tokenizer.from_file(VOCABULARY)
    other.encode_special_tokens = True
    for text in HARD + random_texts(2000):
        assert list(array("I", own.encode(text))) == other.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("block", [500, 1 << 20])
def test_packing_covers_every_id_once(spark, block):
    other = Tokenizer.from_file(VOCABULARY)
    other.encode_special_tokens = True
    rows = [(i, *r[1:]) for i, r in enumerate(odd_documents())]
    out = pack_documents(frame(spark, rows).coalesce(1), VOCABULARY, P.PATTERN, block_tokens=block, step_tokens=4096).collect()
    texts = {r[0]: r[1] for r in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = other.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at:at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    open_windows = 0
    steps = defaultdict(int)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert own[0].tier in TIERS and at <= own[0].tier
        open_windows += at != own[0].tier
        steps[own[0].step_id] += own[0].tier
    assert open_windows <= 1
    assert max(steps.values()) <= 4096
    assert len(steps) == -(-sum(steps.values()) // 4096)   # no more steps than the volume calls for
    part = [v for v in steps.values() if v < 4096]
    assert not part or max(part) - min(part) <= max(TIERS)


def test_what_is_left_of_the_tiers_goes_to_few_equal_steps():
    import random

    from custlens.llm.packing import balanced
    rng = random.Random(4)
    for _ in range(200):
        windows = [(rng.choice(TIERS), i) for i in range(rng.randint(0, 60))]
        steps = balanced(windows, 4096)
        assert sorted(w for s in steps for w in s) == sorted(windows)
        volumes = [sum(w[0] for w in s) for s in steps]
        assert len(steps) == -(-sum(volumes) // 4096) and max(volumes, default=0) <= 4096
        assert max(volumes, default=0) - min(volumes, default=0) <= max(TIERS)
    odd = balanced([(700, i) for i in range(7)], 1000)   # lengths that do not divide the volume
    assert [len(s) for s in odd] == [1] * 7
    assert balanced([(2048, 0)], 1000) == [[(2048, 0)]]   # a window longer than a step is a step


def test_packing_of_repeated_ids_and_clashing_columns(spark):
    """Rows that share an id are documents of their own; other columns do not matter."""
    from tests.llm.common import clashing
    rows, other = odd_documents(), Tokenizer.from_file(VOCABULARY)
    other.encode_special_tokens = True
    plain = pack_documents(frame(spark, rows).coalesce(1), VOCABULARY, P.PATTERN)
    out = pack_documents(clashing(frame(spark, rows).coalesce(1)), VOCABULARY, P.PATTERN)
    want = defaultdict(int)
    for r in rows:
        want[r[0]] += len(other.encode(r[1] or "", add_special_tokens=False).ids) + 1
    found = defaultdict(int)
    for r in out.collect():
        found[r.doc_id] += r.length
    assert found == want and plain.columns == out.columns
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)


def test_irregular_white_space_is_told_alike_with_and_without_other_characters():
    from custlens.llm import units
    rng = random.Random(12)
    for _ in range(20_000):
        t = "".join(rng.choice("ab \n\t\x0b\x0c\r\x1c\x1f" if rng.random() < 0.3 else "abc d\ne") for _ in range(rng.randint(0, 9)))
        assert units.irregular(t) == (units._IRREGULAR.search(t) is not None), repr(t)
        u = t + "é"   # the same text before a letter beyond ASCII
        assert units.irregular(u) == (units._IRREGULAR.search(u) is not None)


def test_packing_of_nothing(spark):
    assert pack_documents(frame(spark, []), VOCABULARY, P.PATTERN).count() == 0


def test_one_queue_for_many_pre_tokens_equals_one_each():
    import random

    import public_tokenizers
    from custlens.llm.bpe import BytePairCodec, read_ranks
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        c = BytePairCodec(read_ranks(f.read()), public_tokenizers.PATTERN)
    rng = random.Random(8)
    pieces = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for alphabet in (b"a", b"ab", b" the", b"thernoing ", bytes(range(256))) for _ in range(300)]
    pieces += [" überraschungen".encode(), "日本語".encode(), b"aaaaaaa" * 8, b"\xff\xfe"] + pieces[:40]
    want = [b"".join(i.to_bytes(4, "little") for i in c.merge(p)) for p in pieces]
    assert c.queue.merge(pieces) == want
    assert c.queue.merge([]) == [] and c.queue.merge([b"a"]) == [c.merge(b"a")[0].to_bytes(4, "little")]
    texts = ["one two  three\nfour\n\n five", "", " ", "x" * 300_000, "the thing in the thing", "\t tab\x0bs"]
    plain = BytePairCodec(c.ranks, public_tokenizers.PATTERN)
    c.prepare(texts)
    for t in texts:
        assert c.encode(t) == plain.encode(t) and c.decode(c.encode(t)) == t.encode()


@pytest.mark.parametrize("cache", [50, 100_000])
def test_texts_are_encoded_together_as_alone_and_look_a_unit_up_once(cache, monkeypatch):
    from custlens.llm.bpe import BytePairCodec, read_ranks
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        c = BytePairCodec(read_ranks(f.read()), P.PATTERN, cache)
    own, other = TokenizerUnits(open(VOCABULARY, "rb").read(), P.PATTERN), Tokenizer.from_file(VOCABULARY)
    other.encode_special_tokens = True
    texts = HARD + random_texts(500) + ["", None, "first\nfirst first", "\tfirst first", "\nfirst", " first", "x" * 70 + " " + "x" * 70, "word, word (word) wörter, wörter\nword,"]
    for encoder in (c, own, c):   # the second time from the caches
        ids, first = encoder.encode_all(texts)
        assert len(first) == len(texts) + 1
        for text, lo, hi in zip(texts, first, first[1:]):
            assert ids[lo:hi].tolist() == other.encode(text or "", add_special_tokens=False).ids == list(array("I", encoder.encode(text))), text
    assert [len(x) for x in own.encode_all([])] == [0, 1]
    seen = []
    monkeypatch.setattr(c, "encode_units", lambda units: seen.append(units) or [b"\1\0\0\0"] * len(units))
    assert len(c.encode_all(["a b a b a", "b a\na"] * 50)[0]) == 400
    assert sorted(map(sorted, seen)) == [["\ta", "\tb", "\na", "a", "b"]]


def test_what_a_slice_needed_is_freed_without_a_search_for_cycles(ranks):
    texts = [f"word{i} other{i}" for i in range(300)]
    for encoder in (BytePairCodec(ranks, P.PATTERN), TokenizerUnits(open(VOCABULARY, "rb").read(), P.PATTERN)):
        encoder.encode_all(texts)
        gc.collect()
        gc.disable()
        try:
            encoder.encode_all(texts)
            assert gc.collect() == 0
        finally:
            gc.enable()


def test_units_kept_by_a_worker_change_no_piece(spark):
    docs = frame(spark, odd_documents()).coalesce(1)
    few, many = [pack_documents(docs, VOCABULARY, P.PATTERN, cache_units=n).collect() for n in (3, 350_000)]
    assert sorted(few, key=repr) == sorted(many, key=repr)
