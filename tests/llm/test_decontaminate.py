"""Decontamination: tiling against brute force, reordered passages, odd input."""

import random

import numpy as np

import brute
from imunis.llm import decontaminate as dc


def test_tiling_equals_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        k = rng.choice([2, 4, 30])
        item = [rng.randint(1, k) for _ in range(rng.randint(1, 25))]
        text = [rng.choice([0, *range(1, k + 1)]) for _ in range(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(item))
            text += item[at:at + rng.randint(1, 12)]
        least = rng.choice([1, 2, 3, 5])
        got, tiles = dc.tile(np.array(item, np.uint64), np.array(text, np.uint64), least)
        plain = brute.tiled(item, [t if t else -i - 1 for i, t in enumerate(text)], least)
        # Ties between equally long matches may be broken differently; the longest is always first.
        assert got >= least * tiles and abs(got - plain) <= max(2 * least, 4) and (got > 0) == (plain > 0)


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_plain_and_reordered_passages_are_found_and_clean_ones_left(spark):
    rng = random.Random(10)
    items = [(i, sentence(rng, 40)) for i in range(8)]
    docs = [(1000 + i, sentence(rng, 200)) for i in range(30)]
    for i, text in items:
        w = text.split()
        docs.append((i, f"{sentence(rng, 50)} {text} {sentence(rng, 30)}"))
        docs.append((100 + i, f"{' '.join(w[20:])} {sentence(rng, 9)} {' '.join(w[10:20])}\n{sentence(rng, 5)} {' '.join(w[:10])}"))
        docs.append((200 + i, f"{sentence(rng, 20)} {' '.join(w[:12])} {sentence(rng, 20)}"))  # 30 percent: not enough
        docs.append((300 + i, "! ".join(x.upper() for x in w)))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(b + i, i) for i, _ in items for b in (0, 100, 300)}
    assert all(r["coverage"] == 1.0 and r["matched_words"] == 40 for r in got if r["doc_id"] < 100)
    assert all(r["n_tiles"] == 3 for r in got if 100 <= r["doc_id"] < 200)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in dc.query(spark, sf).collect()}
    want = set()
    for d in docs:
        text = brute.tokens(d["text"])
        seeds = {tuple(text[j:j + 5]) for j in range(len(text) - 4)}
        for i in items:
            item = brute.tokens(i["text"])
            shared = sum(tuple(item[j:j + 5]) in seeds for j in range(len(item) - 4))
            if shared * 5 >= 0.6 * len(item) and brute.tiled(item, text, 5) >= 0.6 * len(item):
                want.add((d["doc_id"], i["item_id"]))
    assert set(got) == want and want


def test_items_that_repeat_themselves(spark):
    """60 words of period 7 have 7 different windows, which cover all of them."""
    rng = random.Random(11)
    refrain = " ".join(f"r{i % 7}" for i in range(60))
    table = " ".join(["yes no"] * 20)
    half = " ".join(f"r{i % 7}" for i in range(30))
    docs = [(1, f"{sentence(rng, 40)} {refrain} {sentence(rng, 40)}"), (2, f"{sentence(rng, 9)} {table}"), (3, sentence(rng, 90)),
            (4, f"{sentence(rng, 9)} {half} {sentence(rng, 9)}"), (5, "yes no " * 20_000)]
    items = [(1, refrain), (1, refrain), (2, table)]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in got} == {(1, 1, 1.0), (2, 2, 1.0), (5, 2, 1.0)}
    want = {(d, i) for d, text in docs[:4] for i, item in items
            if brute.tiled(brute.tokens(item), brute.tokens(text), 5) >= 0.6 * len(brute.tokens(item))}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] != 5} == want


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 2), (None, item, 3), (4, item, 4), (4, item, 5), (5, "x " * 300_000 + item, 6), (6, "alpha beta", 7)],
        "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "alpha beta"), (None, item + " iota")],
                                  "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (None, 4, 5) for i in (1, None, 4)] + [(6, 4)], key=str)
    assert dc.contaminated(docs.limit(0), bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_items_of_one_to_four_words(spark):
    bench = [(1, "solo"), (2, "Two words"), (3, "three small words"), (4, "just four of them"), (5, "now there are five words")]
    docs = [(i, f"padding here {t.upper()}, and padding there") for i, t in bench] + [(10, "two of the words"), (11, "four just of them"), (12, "them")]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in got.collect()} == {(i, i, 1.0, 1) for i in range(1, 6)}


def test_a_document_that_reaches_the_threshold_has_a_key():
    rng = random.Random(12)
    for _ in range(200):
        n = rng.randint(1, 40)
        item = np.array([rng.randint(1, rng.choice([3, 50])) for _ in range(n)], np.uint64)
        width = min(dc.MIN_MATCH, n)
        seeds = dc._seeds(item, width).view(np.int64).tolist()
        held = {s: rng.randint(1, 20_000) for s in seeds}
        keys = set(dc.key_seeds(item, held, 0.6))
        for _ in range(20):
            some = {s for s in set(seeds) if rng.random() < rng.random()} - keys
            covered = np.zeros(n, bool)
            for at, s in enumerate(seeds):
                if s in some:
                    covered[at:at + width] = True
            assert covered.sum() < 0.6 * n


def test_a_phrase_of_very_many_documents_makes_no_pairs(spark):
    """Half of an item is a phrase that 3,000 documents and all 40 items share."""
    rng = random.Random(13)
    phrase = sentence(rng, 10)
    items = [(i, f"{phrase} {sentence(rng, 10)}") for i in range(40)]
    docs = [(i, f"{sentence(rng, 5)} {phrase} {sentence(rng, 5)}") for i in range(3000)] + [(5000 + i, t) for i, t in items]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = dc.contaminated(*frames)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(5000 + i, i) for i, _ in items}
    for i, text in items:
        words = dc.words(*dc.column_bytes(dc.pa.array([text])), dc.PUNCT, latin=True)[0]
        seeds = dc._seeds(words, 5).view(np.int64).tolist()
        common = set(seeds[:6])  # those of the phrase
        keys = dc.key_seeds(words, {s: 3040 if s in common else 1 for s in seeds}, 0.6)
        assert keys and not common & set(keys)


def test_a_long_repetitive_text_is_tiled_quickly():
    item = np.array([1, 2] * 30, np.uint64)
    text = np.array([1, 2] * 200_000 + [0] + [2, 1, 1] * 50_000, np.uint64)
    assert dc.tile(item, text, 5) == (60, 1)
