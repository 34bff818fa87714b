"""Every registered query against its DuckDB SQL on the sf0.001 tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from imunis.plans import catalog  # noqa: E402
from oracle_check import canon, duck  # noqa: E402

from paths import SF_SMALL  # noqa: E402

SQL = E.oracle_sql()
QUERIES = {n: q for n, q in E.queries().items() if n in catalog.QUERIES}

# Spark simple type -> DuckDB type name, for the schema part of the check.
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
         "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    assert name in SQL, f"{name} has no oracle"
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    dtypes = dict(zip(dcols, [str(t) for t in con.sql(SQL[name]).types]))
    for f in df.schema.fields:
        assert TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) == dtypes[f.name], f.name
    assert len(srows) == len(drows)
    assert canon(srows, df.columns) == canon(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "id_vacinacao" in df.columns
