"""O3: jumps to a page of a list laid out in ranges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from imunis.operators import filters as flt
from imunis.operators import paging

KEYS = [("day", "desc"), ("name", "asc"), ("id", "asc")]
SCHEMA = "id long, day date, name string, `of a` int"


def rows(n, seed=3):
    import datetime as dt
    rnd = random.Random(seed)
    days = [None, dt.date(2030, 1, 1), dt.date(2030, 1, 2)]
    return [(i, rnd.choice(days), rnd.choice(["a", "b", "", None]), i % 5) for i in rnd.sample(range(10 * n), n)]


@pytest.mark.parametrize("parts, size", [(7, 10), (7, 60), (1, 9)])
def test_every_page_equals_offset_paging(spark, scratch, parts, size):
    """Ties and nulls in the leading keys; pages inside a part, over several and beyond the end."""
    df = spark.createDataFrame(rows(150), SCHEMA)
    path = "file:" + os.path.join(scratch, "list")
    paging.lay_out(df, KEYS, path, parts)
    assert paging.number_of_rows(spark, path) == 150
    full = [tuple(r) for r in flt.order(df, KEYS).collect()]
    for n in [0, 1, 3, 150 // size - 1, 150 // size, 150 // size + 1, 400]:
        assert [tuple(r) for r in paging.jump(spark, path, df.schema, KEYS, n, size).collect()] == full[n * size:(n + 1) * size]
    assert [tuple(r) for r in flt.page(df, KEYS, 3, size).collect()] == full[3 * size:4 * size]


def test_a_jump_reads_the_parts_of_its_page(spark, scratch):
    df = spark.range(5000).select(F.col("id"), F.lit(None).cast("date").alias("day"), F.lit("same").alias("name"))
    path = "file:" + os.path.join(scratch, "list")
    paging.lay_out(df, KEYS, path, 20)
    counts = [r["n"] for r in spark.read.parquet(path + "/counts").collect()]
    assert len(counts) == 20 and max(counts) < 1000  # equal leading keys do not share a part
    page = paging.jump(spark, path, df.schema, KEYS, 440, 10)
    assert [r["id"] for r in page.collect()] == list(range(4400, 4410))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_list_and_bad_arguments(spark, scratch):
    df = spark.createDataFrame([], SCHEMA)
    path = "file:" + os.path.join(scratch, "none")
    paging.lay_out(df, KEYS, path, 3)
    assert paging.number_of_rows(spark, path) == 0
    assert paging.jump(spark, path, df.schema, KEYS, 0).collect() == []
    with pytest.raises(ValueError):
        paging.jump(spark, path, df.schema, KEYS, -1)
    with pytest.raises(ValueError):
        paging.lay_out(df.withColumn("_part", F.lit(1)), KEYS, path)
