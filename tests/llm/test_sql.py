"""Queries with SQL: Spark and DuckDB agree on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from oracle_check import canon, duck  # noqa: E402

from imunis.llm import registry  # noqa: E402


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    df = registry.QUERIES[name](spark, sf_dir)
    cur = duck(sf_dir).execute(registry.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), cols)
