import pickle
import random

import corpus_pipeline as cp
import public_tokenizers
from posttrain_spark.llm import linededup
from tokenizers import Tokenizer

from .conftest import prose
from .test_simhash import plain_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path, vocabulary):
    rng = random.Random(12)
    items = [(k, prose(rng, 30, vocabulary)) for k in range(5)]
    rows = [(i, prose(rng, 60, vocabulary) + "\nshared footer") for i in range(40)]
    rows += [(100, rows[0][1]), (101, None), (102, "12 !!"), (103, prose(rng, 30, vocabulary) + " " + items[2][1]), (104, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    counts = {}
    for _, t in kept:
        for k in set(linededup.line_keys(t)):
            counts[k] = counts.get(k, 0) + 1
    kept = [(i, "\n".join(x for x in t.split("\n") if not x or counts[linededup.line_keys(x)[0]] < 10)) for i, t in kept]
    prints = {i: plain_fingerprint(t) for i, t in kept}
    kept = [(i, t) for i, t in kept if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 2 for j in prints)]
    kept = [(i, t) for i, t in kept if not any(x in t for _, x in items)]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got) == {i for i, _ in kept} and 100 not in got and 103 not in got and 101 not in got
    for i, t in kept:
        assert got[i].ids == lib.encode(t, add_special_tokens=False).ids


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "plain words here", "en", "s", 16)], COLUMNS)
    spark.createDataFrame([(1, "other words entirely")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 4 <= len(cp.STAGES) <= 5
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() == 1


def test_odd_rows_and_empty_tables(spark, make, odd, tmp_path):
    """Null ids and texts, repeated rows, very long texts, columns with clashing names, and tables without rows."""
    extra = [(20, "¡Otra fila más!"), (None, "A row without an id.\nAnother line here.")]
    make(odd + extra).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    items = spark.createDataFrame([(1, "otra FILA más"), (2, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    got = cp.run(spark, str(tmp_path / "a")).collect()
    kept = [r for r in odd + extra[1:] if r[0] in (1, None, 6, -7, 8, 9)]  # 5 copies 1, 20 is an item
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in kept)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {i: t for i, t in kept}
    assert all(r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids for r in got)
    make([]).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    items.limit(0).write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path / "b")).count() == 0


def test_decontamination_collects_no_table(spark, tmp_path, monkeypatch):
    """What the stage collects on the driver hasn't the size of words by dimensions."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(12_000)]
    texts = [" ".join(x[a : a + 400]) for x in (rng.sample(words, len(words)) for _ in range(3)) for a in range(0, len(words), 400)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, "x1 x2 x3 x4 x5"])], COLUMNS)
    spark.createDataFrame([(1, "x1 x2 x3 x4 x5")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    collect, got = type(docs).collect, []
    monkeypatch.setattr(type(docs), "collect", lambda rows: got.append(out := collect(rows)) or out)
    kept = cp.benchmark_decontamination(spark, docs, str(tmp_path))
    assert max(len(pickle.dumps([tuple(r) for r in x], 5)) for x in got) < len(words) * 64
    assert {r.doc_id for r in collect(kept)} == set(range(len(texts)))
