"""Substring dedup against brute force: repeats, periodic texts, long texts, hot anchors, odd rows."""

import random
import string

import numpy as np
import pytest

import brute
from imunis.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, kept string, lo int"


def passages(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(30, 400))) for _ in range(12)]
    rows = []
    for d in range(n):
        text = "".join(rng.choice(base)[rng.randint(0, 20):] if rng.random() < .6 else
                       "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 200))) for _ in range(rng.randint(0, 5)))
        kind = rng.random()
        text = ("a" * rng.randint(0, 600) if kind < .1 else "abc" * rng.randint(0, 300) if kind < .2 else None if kind < .25
                else rows[-1][1] if kind < .35 and rows else text)
        rows.append((d * 3 - 50, text))
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in sd.remove_repeats(df).drop("kept").collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    rows = passages(seed)
    assert run(spark, rows) == sorted(brute.remove_repeats(rows))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in sd.query(spark, sf).collect()) == sorted(brute.remove_repeats(rows))


def test_small_blocks_and_hot_anchors():
    """The same stretches, whether contexts are sorted in one block, in many, or dealt out as passages."""
    rng = random.Random(3)
    hot = "".join(rng.choice("abcdefgh ") for _ in range(120))
    # The bytes next to the hot passage differ from text to text, so that it is all they share.
    docs = ["".join(rng.choice("abcdefgh ") for _ in range(89)) + own + hot + own + "".join(rng.choice("abcdefgh ") for _ in range(89))
            for own in string.ascii_letters[8:48]]
    want = {(i, 90, 210) for i in range(1, 40)}
    import pyarrow as pa
    rows = sorted((h, i, 0, d.encode()) for i, d in enumerate(docs) for h in [7])
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
        (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["h", "doc", "lo", "context"])
    plain = {tuple(r[:3]) for b in sd._sort_contexts(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))}
    assert plain == want
    old = sd.BLOCK
    try:
        sd.BLOCK = 2000
        spread = [r for b in sd._sort_contexts(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
    finally:
        sd.BLOCK = old
    first, gone = {}, set()
    for doc, lo, hi, w1, w2 in sorted(spread):
        if (w1, w2) in first:
            gone.update((doc, x) for x in range(lo, hi))
        first.setdefault((w1, w2), (doc, lo))
    assert gone == {(d, x) for d, lo, hi in want for x in range(lo, hi)}


def test_anchors_of_a_long_row_do_not_depend_on_the_piece():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 30_000, np.uint8)
    bounds = np.array([0, 50, 28_000, 28_000, 30_000])
    def gather(piece):
        found = [np.stack([x.astype(np.int64) for x in f]) for f in sd.row_anchors(data, bounds, piece)]
        return {tuple(c) for c in np.concatenate(found, 1).T.tolist()}
    whole = gather(1 << 20)
    parts = gather(1000)
    # Parts may add anchors near their edges (true ones of more passages than they hold), never lose one.
    assert {a for a in whole if a[0] == 1} <= parts | whole and len(parts) >= 0.9 * len(whole)
    need = sd.anchors(data[50:28_000], np.array([0, 27_950]))
    assert {(1, *c) for c in np.stack([x.astype(np.int64) for x in need[1:]]).T.tolist()} <= parts


def test_odd_rows(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(1, "x" * 99), (2, "x" * 99), (3, None), (4, ""), (5, long), (6, long[700_000:] + "!"), (None, "y" * 300), (7, "y" * 150)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[1][2] == got[2][2] == 0 and got[3][1:4] == got[4][1:4] == (0, 0, 0)
    assert got[5][2] == 0 and got[6][1:4] == (800_001, 800_000, 1)
    assert got[7][2] == 150 and got[None][2] == 299  # null counts as the least id
    twice = [(8, "z" * 20 + long[:200]), (8, "z" * 20 + long[:200])]
    assert {r[2] for r in run(spark, twice)} == {0}
    assert run(spark, []) == []
