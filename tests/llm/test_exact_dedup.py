"""Exact dedup: groups, the persistent index, and every odd input."""

import hashlib

import pytest

from imunis.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, digest string, keep_id int"  # the last two clash with the operator's names


def test_groups_and_odd_rows(spark):
    rows = [(1, "Same"), (7, "same"), (3, "SAME"), (4, None), (5, ""), (6, "É"), (8, "é"), (None, "same"), (None, "alone"),
            (9, "twice"), (9, "twice"), (2, "x" * 3_000_000), (10, "X" * 3_000_000)]
    df = spark.createDataFrame([(*r, "d", 0) for r in rows], SCHEMA)
    got = {(r["doc_id"], r["text_sha256"]): r for r in ed.deduplicate(df, ed.new_index(spark)).collect()}
    out = ed.deduplicate(df, ed.new_index(spark)).collect()
    assert len(out) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    same = sha("same")
    assert got[1, same]["keep_id"] == 7 and got[1, same]["group_size"] == 4 and not got[1, same]["kept"]
    assert got[7, same]["kept"] and not got[None, same]["kept"]
    assert got[None, sha("alone")]["kept"] and got[None, sha("alone")]["keep_id"] is None
    assert got[4, sha("")]["keep_id"] == 5 and got[5, sha("")]["kept"]
    assert got[6, sha("É")]["group_size"] == 1  # only A-Z is lower-cased
    assert sorted(r["kept"] for r in out if r["doc_id"] == 9) == [False, True]
    assert got[10, sha("x" * 3_000_000)]["group_size"] == 2


def test_index_outlives_the_batch(spark, scratch):
    path = f"file:{scratch}/index"
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    again = spark.createDataFrame([(9, "a"), (8, "c"), (7, "C")], "doc_id long, text string")
    ed.deduplicate(first, ed.DigestIndex(spark, path, 4)).collect()
    index = ed.DigestIndex(spark, path, 4)
    spark.sql(f"DROP TABLE {index.table}")  # an external table: the folder stays
    got = {r["doc_id"]: (r["kept"], r["keep_id"], r["seen_before"])
           for r in ed.deduplicate(again, ed.DigestIndex(spark, path, 4)).collect()}
    assert got == {9: (False, 3, True), 8: (True, 8, False), 7: (False, 8, False)}
    assert ed.DigestIndex(spark, path, 4).read().count() == 3


def test_a_rerun_gives_the_same(spark, scratch):
    """The driver dies behind the append: the batch runs again, from a new session's view of the folder."""
    path = f"file:{scratch}/index"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (3, "A"), (None, "c")], "doc_id long, text string")
    kept = [sorted(map(str, ed.keep_one(rows, ed.DigestIndex(spark, path, 4)).collect())) for _ in range(3)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3
    index = ed.DigestIndex(spark, path, 4)
    assert index.read().count() == 3
    half = index.read().filter("keep_id = 2").select("digest", "keep_id")
    ed.DigestIndex(spark, f"file:{scratch}/torn", 4).append(half, "b")  # an append of which only a part is there
    torn = ed.DigestIndex(spark, f"file:{scratch}/torn", 4)
    out = ed.deduplicate(rows, torn, batch="b").collect()
    assert sum(r.kept for r in out) == 3 and not any(r.seen_before for r in out) and torn.read().count() == 3
    other = ed.deduplicate(rows, torn, batch="other").collect()
    assert all(r.seen_before and not r.kept for r in other) and torn.read().count() == 3


def test_other_buckets_are_refused(spark, scratch):
    ed.DigestIndex(spark, f"file:{scratch}/index", 4)
    with pytest.raises(ValueError, match="4 buckets"):
        ed.DigestIndex(spark, f"file:{scratch}/index", 8)


def test_the_query_leaves_no_table(spark, sf_small):
    before = {t.name for t in spark.catalog.listTables()}
    ed.query(spark, sf_small).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_anti_join_reads_the_index_without_a_shuffle(spark, scratch):
    index = ed.DigestIndex(spark, f"file:{scratch}/index", 8)
    ed.deduplicate(spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string"), index).collect()
    fresh = spark.createDataFrame([(b"x" * 32, 1)], "digest binary, n int").repartition(8, "digest")
    plan = fresh.join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_empty_and_keep_one(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ed.deduplicate(empty, ed.new_index(spark)).count() == 0
    df = spark.createDataFrame([(1, "A", "p", 5), (2, "a", "q", 6), (2, "a", "r", 7), (3, None, "s", 8)], SCHEMA)
    kept = ed.keep_one(df, ed.new_index(spark))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
