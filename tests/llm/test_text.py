"""Word hashes, shingles, rolling hashes and the suffix array against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

import brute
from imunis.llm import text
from imunis.llm.suffix_array import Suffixes

TEXTS = ["", "Hello  World foo\tbar baz", "a", "É x" * 10, None, "one two three", "x" * 50, " lead", "A b C d e",
         *("the cat sat on the mat " * k for k in range(5))]


def test_words_match_plain_split_whatever_the_piece_size(monkeypatch):
    whole = text.words(*text.column_bytes(pa.array(TEXTS)))
    flat = [w for t in TEXTS for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.FOLD))]
    assert len(whole[0]) == len(flat)
    by_hash = dict(zip(whole[0].tolist(), flat))
    assert [by_hash[h] for h in whole[0].tolist()] == flat and len(by_hash) == len(set(flat))
    monkeypatch.setattr(text, "PIECE", 7)
    again = text.words(*text.column_bytes(pa.array(TEXTS)))
    assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()


def test_shingle_sets_have_the_right_size_and_overlap():
    sets = list(text.shingle_sets(*text.words(*text.column_bytes(pa.array(TEXTS))), 4))
    plain = [brute.shingles(t, 4) for t in TEXTS]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for a, p in zip(sets, plain):
        for b, q in zip(sets, plain):
            assert len(np.intersect1d(a, b)) == len(p & q)


def test_windows_are_equal_exactly_for_equal_windows():
    rng = random.Random(2)
    v = np.array([rng.randrange(3) for _ in range(200)], np.uint64)
    got = text.windows(v, 5)
    seen = {}
    for i, h in enumerate(got.tolist()):
        assert seen.setdefault(h, tuple(v[i:i + 5])) == tuple(v[i:i + 5])
    assert len(seen) == len({tuple(v[i:i + 5]) for i in range(196)})


def test_suffix_array_equals_sorting():
    rng = random.Random(3)
    for _ in range(200):
        k, depth = rng.choice([1, 2, 4, 256]), rng.choice([3, 8, 10, 16, 100])
        strings = [bytes(rng.randrange(k) if k > 1 else 97 for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 12))]
        if rng.random() < .4:
            strings += [strings[0][:20] + b"xyz"] * 2
        least = rng.choice([1, 1, 2, 5, 20])
        s = Suffixes(strings, depth)
        order = s.array(least)
        found = [strings[s.string[p]][p - s.first[s.string[p]]:][:depth] for p in order]
        assert found == sorted(x[i:][:depth] for x in strings for i in range(len(x) - least + 1))
        common = [0] * (len(order) > 0)
        for a, b in zip(found, found[1:]):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            common.append(n)
        assert s.common_prefixes(order).tolist() == common
