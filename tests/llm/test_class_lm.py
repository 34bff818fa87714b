"""op12: base score and model against plain sums, the exchange's gains against the likelihood itself, held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from imunis.llm import class_lm


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def words(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.fixture(scope="module")
def scored(spark, sf_small):
    return class_lm.train_and_score(spark.read.parquet(f"{sf_small}/documents.parquet"), held_out())


@pytest.fixture(scope="module")
def texts(spark, sf_small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}


def test_counts_and_base_score_equal_plain_sums(scored, texts):
    counts = Counter(w for i, t in texts.items() if not held(i) for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    rows = scored.documents.collect()
    assert len(rows) == len(texts) and {r.train_tokens for r in rows} == {total}
    for r in rows:
        tokens = [*words(texts[r.doc_id]), None]
        base = sum(math.log10((counts[w] + .1) / (total + .1 * (distinct + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known) == (held(r.doc_id), len(tokens), sum(counts[w] > 0 for w in tokens))
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_score_equals_the_model_written_out(spark, scored, texts):
    known = {r.word: r for r in scored.words.collect()}
    units = {w: r.unit for w, r in known.items()}
    n_frequent = len(scored.units) - class_lm.RARE - 1
    unseen = sorted({w for t in texts.values() for w in words(t)} - set(known))
    rare = spark.createDataFrame([(w,) for w in unseen], "word string").select("word", class_lm.rare_unit("word", n_frequent).alias("u"))
    units.update({r.word: r.u for r in rare.collect()})
    n, k = scored.transitions, class_lm.CLASSES
    class_of = scored.units
    assert class_of[0] == 0 and all(class_of[r.unit] == r["class"] for r in known.values())
    total = Counter()
    seen = Counter()
    for r in known.values():
        total[r.unit] += r.n
        seen[r.unit] += 1
    once, twice = (sum(r.n == x and r.unit > n_frequent for r in known.values()) for x in (1, 2))
    discount = min(max(once / (once + 2 * twice), .1), .9)
    # Bigrams of classes, counted anew.
    own = np.zeros((k, k))
    for i, t in texts.items():
        if not held(i):
            line = [0, *[class_of[units[w]] for w in words(t)], 0]
            for c, d in zip(line, line[1:]):
                own[c, d] += 1
    assert (own == n).all()
    start = (n.sum(0) + .5) / (n.sum(0) + .5).sum()
    weight = Counter()
    for u, c in enumerate(class_of):
        weight[c] += total[u] + (.5 if u > n_frequent else 0)
    for r in scored.documents.collect():
        line = [0, *[units[w] for w in words(texts[r.doc_id])], 0]
        log = 0.0
        for a, b, w in zip(line, line[1:], [*words(texts[r.doc_id]), None]):
            c, d = class_of[a], class_of[b]
            row = n[c]
            step = (max(row[d] - .5, 0) + .5 * (row > 0).sum() * start[d]) / row.sum() if row.sum() else start[d]
            log += math.log10(step)
            if 0 < b <= n_frequent:
                log += math.log10(total[b] / weight[d])
            elif b:
                log += math.log10((total[b] + .5) / weight[d])
                if total[b]:
                    log += math.log10((known[w].n - discount if w in known else discount * seen[b]) / total[b])
        assert r.score == pytest.approx(log, rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-log / r.n_tokens), rel=1e-9)


def test_gains_equal_the_difference_of_likelihoods():
    rng = np.random.default_rng(3)
    n_units, k = 12, 4
    for _ in range(20):
        bigrams = rng.integers(0, 5, (n_units, n_units))
        classes = rng.integers(0, k, n_units)

        def table(classes):
            out = np.zeros((k, k))
            np.add.at(out, (classes[:, None].repeat(n_units, 1), classes[None, :].repeat(n_units, 0)), bigrams)
            return out
        u = int(rng.integers(n_units))
        others = np.arange(n_units) != u
        own = float(bigrams[u, u])
        after = np.bincount(classes[others], bigrams[u, others], k)
        before = np.bincount(classes[others], bigrams[others, u], k)
        n = table(classes)
        n[classes[u]] -= after
        n[:, classes[u]] -= before
        n[classes[u], classes[u]] -= own
        got = class_lm.gains(n, after, before, own)
        reached = np.array([class_lm.likelihood(table(np.where(others, classes, c))) for c in range(k)])
        assert got - got[0] == pytest.approx(reached - reached[0], abs=1e-6)


def test_the_exchange_raises_the_likelihood_and_held_out_text_gains(scored):
    assert len(scored.likelihoods) > 2 and scored.likelihoods == sorted(scored.likelihoods)
    base, score = scored.documents.filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base * .9  # by a tenth of the digits at least


def test_odd_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b a"), (1, None), (2, ""), (3, " \t "), (4, "x" * 200_000), (5, "a " * 100_000), (5, "A B"), (10 ** 12, "zzz ü Ü")],
                                 "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("unit", F.lit("u"))
    rows = class_lm.train_and_score(docs, F.col("doc_id") == 10 ** 12).documents.collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 1, 2, 3, 4, 4, 100_001]
    assert [(r.n_tokens, r.n_known) for r in rows if r.held_out] == [(4, 1)]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    nothing = class_lm.train_and_score(docs, F.lit(True)).documents.collect()
    assert {(r.base_score, r.train_tokens, r.n_known) for r in nothing} == {(0.0, 0, 0)} and all(math.isfinite(r.score) for r in nothing)
    assert class_lm.train_and_score(docs.limit(0), held_out()).documents.collect() == []
