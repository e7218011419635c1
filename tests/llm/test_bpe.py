import hashlib
import random

import numpy as np
import public_tokenizers
from posttrain_spark.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def lib():
    return Tokenizer.from_file(PATH)


def want(t, text):
    ids = t.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)


def test_equals_the_library(odd):
    rng = random.Random(8)
    alphabet = [chr(c) for c in range(600)] + list("ΣſKİẞ٠Ⅷ½〇日ｆ​ ́") + ["\U0001f600", "<|endoftext|>", "<|startoftext|>"]
    texts = [t or "" for _, t in odd] + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400)]
    t, coder = lib(), bpe.WordBpe(PATH)
    for text, got in zip(texts, coder.encode_batch(texts), strict=True):
        assert got == want(t, text), repr(text[:80])


def test_trees_agree_with_plain_merging():
    """Lanes, lists and a rescan for the lowest, leftmost rank give the same symbols."""
    rng = random.Random(5)
    pairs, n = {}, 6
    for rank in range(40):
        p = (rng.randrange(n), rng.randrange(n))
        if p not in pairs:
            pairs[p] = (rank, n)
            n += 1
    table = bpe.PairTable(pairs, n + 1)
    for _ in range(500):
        word = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        plain = list(word)
        while ranked := [(pairs[p], i) for i, p in enumerate(zip(plain, plain[1:], strict=False)) if p in pairs]:
            (_, merged), i = min(ranked, key=lambda x: (x[0][0], x[1]))
            plain[i : i + 2] = [merged]
        lane = np.full((1, 64), -1, np.int64)
        lane[0, : len(word)] = word
        out = bpe.merge_many(lane, np.array([len(word)]), table)[0]
        assert bpe.merge_one(word, table) == plain == out[out >= 0].tolist()


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    t, coder = lib(), bpe.WordBpe(PATH)
    for k in range(20):
        texts = [f"word{k}x{j} and <|endoftext|> w{j}" for j in range(30)]
        assert coder.encode_batch(texts) == [want(t, x) for x in texts]
        assert len(coder.by_piece) <= 150


def test_table(make, odd):
    t = lib()
    got = sorted((tuple(r) for r in bpe.encode_documents(make(odd), PATH, ids=True).collect()), key=repr)
    exp = []
    for i, text in odd:
        ids, decoded = want(t, text or "")
        exp.append((i, len(ids.split()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), [int(x) for x in ids.split()]))
    assert got == sorted(exp, key=repr)
    assert bpe.encode_documents(make([]), PATH).count() == 0
