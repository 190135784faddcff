import collections
import math
import re

from pyspark.sql import functions as F

from custlens.llm.quality_rules import filter_documents, verdicts
from tests.llm.common import clashing, folder, frame, odd_documents, sentence
import random


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(g)
    covered = {i + j for i, x in enumerate(g) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_counts_equal_brute_force(spark):
    rows = odd_documents() + [(900, "a b c a b c d\n\na b\na b\n # $", "x", None, 1), (901, "the cat " * 26 + "x " * 3, "x", None, 1)]
    out = verdicts(clashing(frame(spark, rows))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((r[0], *base(r[1])) for r in rows), key=repr)


def test_thresholds_by_group(spark):
    """A source where symbols are usual keeps them; elsewhere the same share is rejected."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        source = "code" if i % 2 else "prose"
        t = sentence(rng, 80)
        if source == "code":
            t = " ".join(w + ("<>" if rng.random() < 0.8 + 0.2 * rng.random() else "") for w in t.split())
        rows.append((i, t, "en", source, 1))
    symbols = " ".join(w + "<>" for w in sentence(rng, 80).split())
    rows += [(1000, symbols, "en", "code", 1), (1001, symbols, "en", "prose", 1), (1002, symbols, "en", "tiny", 1), (1003, sentence(rng, 80), "en", "tiny", 1)]
    kept = {r.doc_id: r.kept for r in verdicts(frame(spark, rows)).collect()}
    assert kept[1000] and not kept[1001] and kept[1003]
    assert sum(kept[i] for i in range(600)) >= 590


def brute_kept(rows):
    """``kept`` by exact quantiles of each group, its language and everything."""
    passed, shares = [], []
    for r in rows:
        t = r[1] or ""
        n_words, chars, symbols, dup, repeat, failed = base(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        shout = sum(c == "!" or "A" <= c <= "Z" for c in t)
        shares.append((symbols / max(chars, 1), shout / max(chars, 1), dup / max(lines, 1), repeat / max(n_words, 1)))
        passed.append(not failed)

    def limits(of):
        own = [shares[i] for i in of if passed[i]]
        out = []
        for k, step in enumerate((0.05, 0.2, 0.4, 0.3)):
            x = sorted(s[k] for s in own)
            low, mid, high = (x[math.ceil(q * len(x)) - 1] for q in (0.1, 0.5, 0.9))
            out.append(min(mid + max(step, 8 * min(mid - low, high - mid)), (1 + mid) / 2))
        return out, len(own)

    def mixed(own, n, wider):
        return [n / (n + 100) * a + 100 / (n + 100) * b for a, b in zip(own, wider)]

    everything, _ = limits(range(len(rows)))
    kept = []
    for i, r in enumerate(rows):
        near = [j for j, x in enumerate(rows) if x[2:4] == r[2:4]]
        lang = [j for j, x in enumerate(rows) if x[2] == r[2]]
        limit = mixed(*limits(lang), everything)
        limit = mixed(*limits(near), limit) if any(passed[j] for j in near) else limit
        kept.append(passed[i] and all(s <= m for s, m in zip(shares[i], limit)))
    return kept


def mixed_documents(n=240):
    rng = random.Random(21)
    rows = []
    for i in range(n):
        words = sentence(rng, rng.randint(55, 90)).split()
        often = (i % 3) * rng.random() * 0.5
        words = [w + ("#" if rng.random() < often else "") for w in words]
        if i % 11 == 0:
            words = [w.upper() for w in words]
        lines = [" ".join(words[j:j + 8]) for j in range(0, len(words), 8)]
        if i % 13 == 0:
            lines += [lines[0]] * rng.randint(1, 6)
        rows.append((i, "\n".join(lines), ["en", "de", None][i % 7 % 3], f"s{i % 3}", 1))
    return rows


def test_verdicts_equal_exact_quantiles(spark):
    rows = mixed_documents()
    kept = {r.doc_id: r.kept for r in verdicts(frame(spark, rows)).collect()}
    expected = brute_kept(rows)
    assert [kept[r[0]] for r in rows] == expected
    assert 20 < sum(not k for k in expected) < 200


def test_a_row_more_does_not_turn_a_source_around(spark):
    """A source with symbols beside a clean one, on both sides of a size where limits once changed."""
    def share(n):
        rng = random.Random(4)
        rows = [(i, sentence(rng, 80), "en", "clean", 1) for i in range(300)]
        rows += [(1000 + i, " ".join(w + ("<>" if rng.random() < 0.3 + 0.4 * rng.random() else "") for w in sentence(rng, 80).split()), "en", "code", 1) for i in range(n)]
        return sum(r.kept for r in verdicts(frame(spark, rows)).collect() if r.doc_id >= 1000) / n
    assert abs(share(99) - share(100)) < 0.03


def test_filter_keeps_columns_and_nothing(spark):
    df = clashing(frame(spark, odd_documents()))
    kept = filter_documents(df)
    assert kept.columns == df.columns
    ids = {(r.doc_id, r.text) for r in kept.collect()}
    assert ids and all(not base(t)[5] for _, t in ids)
    assert filter_documents(df.limit(0)).count() == 0
    assert verdicts(frame(spark, [])).count() == 0
