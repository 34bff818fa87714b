"""Jaccard join against brute force: light and heavy sets, chains, hot groups, odd rows; components."""

import random

import pytest

import brute
from imunis.llm import jaccard_join as jj
from imunis.llm.components import components


def family(seed, sizes=(2, 4, 5, 8, 9, 12, 20, 40, 80, 200, 300), groups=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(words)))
    rng.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, component_id int, n int").repartition(3)
    return sorted((tuple(r) for r in jj.near_groups(df, **kw).collect()), key=str)


@pytest.mark.parametrize("seed, width, percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_families(spark, seed, width, percent):
    rows = family(seed)
    assert run(spark, rows, width=width, percent=percent) == sorted(brute.near_groups(rows, width, percent), key=str)


def test_a_chain_and_a_large_group(spark):
    """Each text differs a little from the one before: one component, though its ends have nothing in common."""
    words = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(70):
        rows.append((500 - i, " ".join(words)))
        words = words[2:] + [f"n{i}a", f"n{i}b"]
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(copy)))
    want = brute.near_groups(rows)
    assert run(spark, rows) == sorted(want, key=str)
    assert len({c for d, _, c in want if d <= 500}) == 1


def test_rounds_of_central_nodes_lose_nothing(spark, monkeypatch):
    rows = family(5, sizes=(60, 100), groups=6) + [(10_000 + d, t) for d, t in family(6, sizes=(60,), groups=4)]
    monkeypatch.setattr(jj, "ROUND_COST", 0)
    assert run(spark, rows) == sorted(brute.near_groups(rows), key=str)


def test_large_groups_that_share_a_key_but_do_not_link(spark, monkeypatch):
    """Two groups of 30 with a few rare words in common: a round that adds no link must not be repeated for ever."""
    common, a, b = ([f"{x}{i}" for i in range(n)] for x, n in (("s", 10), ("a", 60), ("b", 60)))
    rows = [(100 * g + i, " ".join(common + own + [f"e{g}x{i}x{j}" for j in range(3)])) for g, own in ((1, a), (2, b)) for i in range(30)]
    # Long texts that make the groups' own words more frequent than those they share, so that the shared ones are keys.
    rows += [(1000 + i, " ".join(a + b + [f"u{i}x{j}" for j in range(300)])) for i in range(80)]
    real, rounds = jj.materialize, []

    def counted(df, label, slim=False):
        rounds.append(label)
        assert rounds.count("open-lists") < 9, "rounds without end"
        return real(df, label, slim)

    monkeypatch.setattr(jj, "materialize", counted)
    got = run(spark, rows, width=1, percent=60)
    assert rounds.count("open-lists") == 2  # one with some nodes, then all pairs
    assert got == sorted(brute.near_groups(rows, 1, 60), key=str)
    assert {c for d, _, c in got if d < 1000} == {100, 200}


def test_boilerplate_with_own_words_makes_few_pairs(spark, monkeypatch):
    """A thousand texts of one phrase and a name of 2 to 6 words: those of 2 link, the others do not; no pair of each two."""
    phrase = [f"p{i}" for i in range(24)]
    rows = [(i, " ".join(phrase + [f"n{i}x{j}" for j in range(2 + i % 5)])) for i in range(1000)]
    rows += [(5000 + i, " ".join(phrase[: 20 + i])) for i in range(4)]
    real, made = jj.materialize, []

    def counted(df, label, slim=False):
        out = real(df, label, slim)
        if label == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(jj, "materialize", counted)
    got = run(spark, rows, width=1, percent=85)
    assert got == sorted(brute.near_groups(rows, 1, 85), key=str)
    assert sum(made) < 10 * len(rows), made


def test_classes_of_a_key_lose_no_pair(spark):
    """All pairs of a key that can link, and no others, whatever their sizes and places."""
    rng = random.Random(8)
    rows = [(k, d, n := rng.randint(1, 60), rng.randrange(n), rng.choice([d, 7])) for d in range(150) for k in (1, 2)]
    now = spark.createDataFrame(rows, "key long, doc long, n int, place int, component long")
    for percent in (60, 85, 100):
        got = {(min(r.doc, r.b), max(r.doc, r.b)) for r in jj._across(now, percent).collect()}
        want = set()
        for k, d, n, p, c in rows:
            for l, e, m, q, o in rows:
                need = -(-percent * (n + m) // (100 + percent))
                if k == l and d < e and c != o and need <= min(n, m) and p + need <= n and q + need <= m:
                    want.add((d, e))
        assert got == want and (want or percent == 100)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in jj.query(spark, sf).collect()) == brute.near_groups(rows)


def test_boundary_is_where_the_costs_meet():
    assert jj.boundary({}, 85) == 0 and jj.boundary({6: 10, 7: 10}, 85) >= 7
    x = jj.boundary({s: 1 for s in range(1, 65)}, 85)
    assert 10 < x < 63
    assert jj.boundary({60: 10**6}, 85) < 60


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one TWO"), (5, "One two"), (None, "one two"), (6, "dup " * 40), (6, "dup " * 40),
            (7, " ".join(f"l{i}" for i in range(150_000))), (8, " ".join(f"l{i}" for i in range(149_000)))]
    got = run(spark, rows)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, None), (6, 1, 6), (6, 1, 6),
                          (7, 149_997, 7), (8, 148_997, 7)], key=str)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int")
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, 6, 6, 7]))


def test_components_of_a_random_graph(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(90)] + \
        [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
