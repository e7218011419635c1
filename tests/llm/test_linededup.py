import random
from collections import Counter

import numpy as np
import pytest
from posttrain_spark.llm import linededup as ld


def brute(rows, min_docs, keep="none"):
    counts, first = Counter(), {}
    for i, t in rows:
        keys = {k for k in ld.line_keys(t or "") if k}
        counts.update(keys)
        for k in keys:
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        lines, kept, seen = (t or "").split("\n"), [], set()
        for line, key in zip(lines, ld.line_keys(t or ""), strict=True):
            if counts.get(key, 0) >= min_docs:
                if keep == "none" or first.get(key) != i or key in seen:
                    continue
                seen.add(key)
            kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture
def rows(odd):
    rng = random.Random(6)
    lines = [f"Line {k}" for k in range(12)] + ["", " ", "\tLINE 3 \r", "É", "é"]
    return odd + [(100 + i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("broadcast_rows", [1 << 20, 0])
@pytest.mark.parametrize("filter_bits", [1 << 20, 1 << 10])  # the small one is full: everything is suspected
def test_against_brute_force(make, rows, keep, broadcast_rows, filter_bits):
    docs = make(rows).repartition(5)
    out = ld.dedup_lines(docs, min_docs=10, keep=keep, filter_bits=filter_bits, broadcast_rows=broadcast_rows)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, 10, keep)


def test_documents_keep_their_columns(make, rows):
    docs = make(rows)
    out = ld.strip_repeated_lines(docs, min_docs=10)
    assert out.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(((i, t) for i, _, _, t in brute(rows, 10)), key=repr)
    assert sorted(((r.doc_id, r.text) for r in ld.strip_repeated_lines(docs, min_docs=10, broadcast_rows=0).collect()), key=repr) == sorted(((i, t) for i, _, _, t in brute(rows, 10)), key=repr)


def test_rows_count_as_documents(spark, make, rows, tmp_path, odd):
    """Rows of one id are documents of their own, in the SQL of the query too."""
    import duckdb
    from posttrain_spark.llm import queries

    repeated = rows + [(100, "a line that only rows of one id share")] * 10
    make(repeated).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op9_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP9_SQL).fetchall(), key=repr)
    assert sum(r[2] for r in got if r[0] == 100) >= 10


def test_filter_grows_with_the_lines(make):
    size = lambda n: ld.filter_size(make([(1, "\n" * n), (2, None)]))
    assert size(10) == ld.LEAST_BITS and size(1_000_000) == 1 << 24 and ld.filter_size(make([])) == ld.LEAST_BITS


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    a, b = ld.Twin(1 << 16), ld.Twin(1 << 16)
    a.add(h[:3000])
    a.add(h[2500:3000])
    b.add(h[2900:])
    twice = a.twice | b.twice | (a.once & b.once)
    again = h[2500:3000]
    for p in ld.probes(again, 1 << 16):
        assert ((twice[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all()


def test_empty(make):
    assert ld.dedup_lines(make([])).count() == 0
    with pytest.raises(ValueError):
        ld.dedup_lines(make([]), keep="last")
