import random
import re

from posttrain_spark.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(text)
    places = [(i, label) for p, label in lic.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_phrases_against_brute_force(make, odd):
    rng = random.Random(2)
    parts = ["CC", "by", "cc-by", "All", "rights", "reserved.", "General", "public", "license", "General Public License", "K", "lİcense", "né", "x", "\x7f", "5", "\n"]
    rows = odd + [(100 + i, " ".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(200)]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in lic.scan_licenses(make(rows)).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)


def test_notices(make):
    mit = next(t for t, x in lic.NOTICES.items() if x == "mit" and len(t) > 100)
    ws = mit.split()
    gapped = " ".join(ws[:15] + ["really", "and", "truly"] + ws[15:28] + ws[30:])
    rows = [(1, mit.upper()), (2, "intro " * 50 + gapped), (3, " ".join(ws[:9])), (4, "Licensed under the Apache License, Version 2.0."), (5, " ".join(reversed(ws))), (6, "plain text"), (6, "plain text")]
    got = sorted((r.doc_id, r.labels, round(r.score, 2)) for r in lic.scan_licenses(make(rows)).collect())
    assert [(i, x) for i, x, _ in got] == [(1, "mit"), (2, "mit"), (3, ""), (4, "apache-2.0"), (5, ""), (6, ""), (6, "")]
    assert got[0][2] == 1.0 and 0.6 <= got[1][2] < 1


def brute_labels(text):
    """Labels and score by matching k-grams, merging diagonals and searching chains, the plain way."""
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    labels, score = set(), 0.0
    for texts, k in ((lic.PHRASES, 2), (lic.NOTICES, 3)):
        for template, label in texts.items():
            t = template.split()
            n = len(t) - k + 1
            found = sorted((i - j, i, j) for i in range(len(ws) - k + 1) for j in range(n) if ws[i : i + k] == t[j : j + k])
            groups = []
            for d, i, j in found:
                if not groups or d - groups[-1][-1][0] > (0 if k == 2 else lic.DRIFT):
                    groups.append([])
                groups[-1].append((d, i, j))
            for g in groups:
                g = sorted((i, -j) for _, i, j in g)
                best = []  # longest chain that ends at each match, with its first place
                for x, (i, j) in enumerate(g):
                    before = [b for b, (p, o) in zip(best, g[:x], strict=True) if p < i and -o < -j]
                    longest = max((b[0] for b in before), default=0)
                    best.append((longest + 1, i))
                share = max(b[0] for b in best) / n
                if share == 1 if k == 2 else share >= lic.COVERAGE:
                    labels.add(label)
                    score = max(score, share)
    return ",".join(sorted(labels)), score


def test_notices_against_brute_force(make, odd):
    """Pieces of notices, with words left out, put in, repeated and moved."""
    rng = random.Random(12)
    notices = list(lic.NOTICES)
    rows = list(odd)
    for i in range(150):
        ws = rng.choice(notices).split()
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(ws))
            ws[at : at + rng.randrange(3)] = [rng.choice(["x", "the", "of this", "software"])] * rng.randrange(4)
        if i % 5 == 0:
            ws = ws[len(ws) // 2 :] + ws[: len(ws) // 2]
        rows.append((100 + i, " ".join(["intro"] * rng.randrange(9) + ws + rng.choice(notices).split()[: rng.randrange(40)])))
    got = sorted(((r.doc_id, r.labels, round(r.score, 9)) for r in lic.scan_licenses(make(rows)).collect()), key=repr)
    want = sorted(((i, x, round(s, 9)) for i, t in rows for x, s in [brute_labels(t)]), key=repr)
    assert got == want and len({x for _, x, _ in got}) > 8


def test_scrambled_and_drifting_notices(make):
    """Triples of a notice in reverse order, or with words put in until it is far longer, are no notice."""
    ws = next(t for t, x in lic.NOTICES.items() if x == "apache-2.0" and len(t) > 150).split()
    reverse = " ".join(" ".join(ws[i : i + 3]) for i in range(len(ws) - 3, -1, -1))
    stretched = " ".join(" ".join([*ws[i : i + 3], "a", "b", "c", "d"][: 7 if i else 3]) for i in range(0, len(ws) - 2))
    got = {r.doc_id: r.labels for r in lic.scan_licenses(make([(1, reverse), (2, stretched), (3, " ".join(ws))])).collect()}
    assert got == {1: "", 2: "", 3: "apache-2.0"}


def test_own_templates(spark, make, monkeypatch):
    """Templates are data; beyond the bound they are joined by shuffle, with the same rows."""
    table = spark.createDataFrame([("one two three four five six", "mine", 3), ("seven eight", "short", 2)], "template string, label string, k int")
    docs = make([(1, "x one two three four five six"), (2, "Seven, eight!"), (3, None)])
    want = sorted(map(tuple, lic.scan_licenses(docs, table=table).collect()))
    assert [(r[0], r[2], r[6]) for r in want] == [(1, 0, "mine"), (2, 1, "short"), (3, 0, "")]
    monkeypatch.setattr(lic, "BROADCAST_GRAMS", 0)
    assert sorted(map(tuple, lic.scan_licenses(docs, table=table).collect())) == want


def test_base_labels_stay_in_labels(make):
    (r,) = lic.scan_licenses(make([(1, "GNU General Public License. Released under the MIT License. All rights reserved")])).collect()
    assert r.base_labels == "gpl,reserved" and r.labels == "gpl,mit,reserved" and r.score == 1.0 and (r.first_word, r.last_word, r.n_base) == (1, 9, 2)


def test_empty(make):
    assert lic.scan_licenses(make([])).count() == 0
