import random
import re

import pytest
from posttrain_spark.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(ws)
    return (n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_counts_against_brute_force(make, odd):
    rng = random.Random(1)
    rows = odd + [(100 + i, " ".join(rng.choice("ab#") * rng.randrange(1, 3) + rng.choice(["", "\n", "\t "]) for _ in range(rng.randrange(60)))) for i in range(150)]
    got = sorted((tuple(r)[:7] for r in q.judge(make(rows)).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)


def test_host_verdicts(make):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "bad", "en", "spam") for i in range(40)] + [(50, good, "en", "spam")]
    rows += [(100 + i, good + f" {i}", "en", "fine") for i in range(60)] + [(200, "bad", "en", "tiny"), (201, good, "en", "tiny"), (300, good, "en", None)]
    got = {r.doc_id: r for r in q.judge(make(rows)).collect()}
    assert not got[50].kept and not got[50].base_failed and got[50].host_rate > 0.9
    assert got[100].kept and got[201].kept and got[300].kept and not got[200].kept
    assert 0 < got[201].host_rate < 0.6


def test_prior_strength():
    """Hosts drawn from a beta prior give its strength back; chance alone, single documents and a single host pool."""
    rng = random.Random(6)
    for want in (2.0, 10.0, 50.0):
        hosts = [(n, sum(rng.random() < p for _ in range(n))) for n in (rng.randrange(1, 60) for _ in range(6000)) for p in [rng.betavariate(0.3 * want, 0.7 * want)]]
        assert strength_of(hosts) == pytest.approx(want, rel=0.15)
    assert strength_of([(10, sum(rng.random() < 0.3 for _ in range(10))) for _ in range(5000)]) > 200
    assert strength_of([(1, k % 2) for k in range(100)]) == 1e6 and strength_of([(50, 20)]) == 1e6 and strength_of([(5, 0)]) == 1e6
    assert strength_of([(50, 50), (50, 0)]) == 1.0 and q.prior_strength(0.0, 0.0, 0, 0, 0.0) == 1e6


def strength_of(hosts):
    n, f = sum(n for n, _ in hosts), sum(f for _, f in hosts)
    return q.prior_strength(f / n, sum(k * (x / k - f / n) ** 2 for k, x in hosts), len(hosts), n, float(sum(k * k for k, _ in hosts)))


def test_hosts_of_one_page(make):
    """A host's only page, failed, doesn't condemn it when half of all such hosts have one."""
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good if i % 2 else "bad", "en", f"host{i}") for i in range(40)] + [(99, good, "en", "host0")]
    got = {r.doc_id: r for r in q.judge(make(rows)).collect()}
    assert got[99].kept and all(r.host_rate < 0.6 for r in got.values())


def test_odd_rows_have_verdicts(make, odd):
    got = sorted((tuple(r)[0] is None, r.doc_id or 0, r.base_failed, r.kept) for r in q.judge(make(odd)).collect())
    assert got == sorted((d is None, d or 0, brute(t)[5], False) for d, t in odd)


def test_empty(make):
    assert q.judge(make([])).count() == 0
