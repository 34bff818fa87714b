"""BPE against the tokenizers library, and the pair test against the merges."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from imunis.llm import bpe, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_vocabulary()
    return bpe.load(path), Tokenizer.from_file(path)


def test_encoding_equals_the_library(pair):
    own, library = pair
    rng = random.Random(1)
    texts = ["", " ", "a" * 5000, "the" * 2000, " " * 3000, "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "\x1c\x85\u3000x", "it's WE'LL"]
    for _ in range(3000):
        n, kind = rng.randint(0, 30), rng.random()
        if kind < .4:
            texts.append("".join(chr(rng.choice([rng.randint(0, 0x2ff), rng.randint(0x2000, 0x3100), rng.randint(0, 0xd7ff),
                                                 rng.randint(0xe000, 0x10ffff)])) for _ in range(n)))
        elif kind < .7:
            texts.append("".join(rng.choice("aeinrst  '\n\tlvdm.9!?") for _ in range(n)))
        else:
            texts.append("".join(rng.choice(["the", "ing", " ", "tion", "<|endoftext|>", "aaa", "  ", "\n", "\u3000", "\x85", "é"])
                                 for _ in range(n)))
    for text, ids in zip(texts, own.encode_batch(texts, limit=20_000)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:60]
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_pair_test_says_what_the_merges_do(pair):
    own, _ = pair
    rng = random.Random(5)
    a = np.array([rng.randrange(50256) for _ in range(4000)] + [rng.randrange(600) for _ in range(4000)])
    b = np.array([rng.randrange(50256) for _ in range(4000)] + [rng.randrange(600) for _ in range(4000)])
    whole = np.array([own.prefixes.get(own.text[i]) == i for i in range(50256)])
    use = whole[a] & whole[b]
    a, b = a[use], b[use]
    want = [own.merge(own.text[i] + own.text[j]) == [i, j] for i, j in zip(a.tolist(), b.tolist())]
    assert own.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_memory_bound_makes_no_difference(pair, monkeypatch):
    own, library = pair
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    texts = [f"word{i} shared text" for i in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts, limit=40)] == \
        [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_and_odd_rows(spark, pair):
    own, _ = pair
    rows = [(1, None, 5), (None, "null id", 6), (2, "twice", 7), (2, "twice", 8), (3, "x " * 400_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = [tuple(r) for r in bpe.encode_documents(df, with_ids=True).collect()]
    want = []
    for d, t, _ in rows:
        ids = own.encode(t or "")
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(),
                     np.frombuffer(ids, "<u4").tolist()))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_token_counts_against_brute_force(spark, pair):
    own, _ = pair
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"))
    lengths = [len(own.encode(r["text"] or "")) // 4 for r in docs.collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(docs)).cache()
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_over"] == sum(x > n for x in lengths)
        assert r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["total_docs"] == len(lengths) and r["total_tokens"] == sum(lengths)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert abs(r["quantile"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    limits = token_counts.at_limits(sums, [0, 1, 100, 513, 10**6])
    for r in limits.collect():
        assert (r["docs_over"], r["tokens_over"], r["truncated_tokens"]) == (
            sum(x > r["limit"] for x in lengths), sum(x for x in lengths if x > r["limit"]),
            sum(min(x, r["limit"]) for x in lengths))
    half = token_counts.length_at(sums, 0.5).first()[0]
    assert sum(x <= half for x in lengths) >= len(lengths) / 2 > sum(x < half for x in lengths)
    assert token_counts.suffix_sums(token_counts.histogram(docs.limit(0))).count() == 0


def test_suffix_sums_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 3)
    hist = spark.createDataFrame([(n, n % 4 + 1) for n in range(0, 40, 3)], "n_tokens long, n_docs long")
    lengths = [n for n in range(0, 40, 3) for _ in range(n % 4 + 1)]
    for r in token_counts.suffix_sums(hist).collect():
        assert r["docs_over"] == sum(x > r["n_tokens"] for x in lengths)
        assert r["truncated_tokens"] == sum(min(x, r["n_tokens"]) for x in lengths)
