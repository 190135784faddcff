import re

from custlens.llm.licenses import CONTAINMENT, LOWER, PHRASES, STRIDE, TEMPLATES, UPPER, scan
from tests.llm.common import clashing, frame, got, odd_documents


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    places, base, found, best = [], set(), set(), 0.0
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, template in TEMPLATES:
        s = set(template.split())
        for i in range(0, len(w), STRIDE):
            share = len(s & set(w[i:i + 2 * STRIDE])) / len(s)
            if share >= CONTAINMENT:
                found.add(label)
                best = max(best, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else best


def test_equals_brute_force(spark):
    texts = [t for _, t in TEMPLATES]
    texts += ["Under the MIT License. under  THE-mit/license", "x " * 30 + "Apache License, Version 2.0" + " y" * 40, "CC BY-NC 4.0 cc by nc", "underthe mit license", "under the mit licenses",
              "İunder the mit licenseK under the mit license", "this program is free software you can " * 3, "all rights", "rights all reserved", "mit " * 200,
              "licensed under apache license version 2", " ".join(TEMPLATES[0][1].split()[4:]), " ".join(TEMPLATES[0][1].split()[1:]), "z " * 23 + TEMPLATES[6][1], "z " * 37 + TEMPLATES[3][1].upper()]
    rows = odd_documents() + [(2000 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = scan(clashing(frame(spark, rows)))
    expected = sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert got(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == expected


def test_no_documents(spark):
    assert scan(frame(spark, [])).count() == 0
