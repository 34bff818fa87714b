"""op13 against plain counts of all phrases, and the quicksort against a Counter."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from imunis.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30, top=2000, absorbed=80):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        inside = Counter()
        for p, n in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], n)
        kept = []
        for p, a in found.items():
            if 100 * inside[p] >= absorbed * a and inside[p]:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("least, top", [(30, 2000), (2, 300), (5, 2000)])
def test_whole_table_equals_plain_counts(spark, sf_small, least, top):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    expected = plain([(r.text, r.lang) for r in docs.collect()], least, top)
    assert len(expected) > 20 and got(collocations.collocations(docs, least, top)) == expected


def test_heavy_pairs_small_routes_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "the", "end."], 60, p=[.4, .4, .1, .05, .05])) for _ in range(120)]
    rows = [(t, ["x", "y", None][i % 3]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    expected = plain(rows, 3)
    assert got(collocations.collocations(docs, 3)) == expected  # nearly all pairs are heavy
    monkeypatch.setattr(collocations, "HEAVY", 2.0)
    assert got(collocations.collocations(docs, 3)) == expected


def test_quicksort_equals_a_counter():
    rng = np.random.default_rng(1)
    for size, words, least in ((0, 3, 2), (5, 3, 1), (5000, 4, 30), (20000, 40, 7), (3000, 3000, 2)):
        suffixes = collocations.suffixes(rng.integers(0, words, size))
        keys = [collocations.pair_of(suffixes), suffixes["w2"], suffixes["w3"]]
        found = {}
        for depth, at, n in collocations.multikey_quicksort(keys, suffixes["n"].astype(np.int64), least):
            phrase = tuple(int(suffixes[f"w{i}"][at]) for i in range(depth + 2))
            assert phrase not in found
            found[phrase] = n
        expected = Counter()
        for row in suffixes.tolist():
            for k in (2, 3, 4):
                if row[k - 1]:
                    expected[row[:k]] += row[4]
        assert found == {p: n for p, n in expected.items() if n >= least}


def test_odd_rows(spark):
    rows = [("A b\tC. a B c;A b c\na b c", "en"), (None, "en"), ("", None), ("a b " * 40000, None), ("é Ü\x00x " * 3, "fr"), ("é Ü\x00x " * 3, "fr"),
            ("x" * 100_000 + " y ", "de"), ("a\x1cb c a\x1cb c", "de"), ("... ,,, !?", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit("x")).withColumn("word", F.lit(1)).withColumn("kind", F.lit(7))
    assert got(collocations.collocations(docs, 2)) == plain(rows, 2)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs, 10 ** 9).collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    big = 9 * 10 ** 17
    words = spark.createDataFrame([("x", "a", big, 1), ("x", "b", big + 7, 2)], "lang string, word string, n long, id long")
    frequent = spark.createDataFrame([([1, 2], big - 3)], "words array<long>, n long")
    (row,) = collocations.score(words, frequent).collect()
    assert row.score == 2000000 * (big - 3) // (2 * big + 7)
