"""O3: jumps to any page of a long list.

``filters.page`` keeps the rows of all pages before the one asked for. A list
that is paged through often is laid out once instead: range partitioned by the
list's order into parts, with the number of rows of each. The running sum of
these numbers says in which parts a page lies, and a jump reads those alone,
whatever the page's number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import order, sort_key

Keys = Sequence[tuple[str, str]]
PART = "_part"


def lay_out(df: DataFrame, keys: Keys, path: str, parts: int | None = None) -> None:
    """Write the list ``df`` in the total order ``keys`` under ``path``, in ``parts``
    ranges (by default as many as a shuffle has partitions).

    Spark picks the ranges from a sample of the rows, so the list is worked out
    twice. The order ends with a unique key, so equal leading values do not put
    rows into one range. The list must not have a column ``_part``.
    """
    spark = df.sparkSession
    if PART in df.columns:
        raise ValueError(f"the list has a column {PART}")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *[sort_key(c, d) for c, d in keys]).withColumn(PART, F.spark_partition_id()) \
        .write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    rows = spark.read.schema(f"{df.schema.toDDL()}, {PART} int").parquet(f"{path}/rows")
    # One row for each part.
    rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def jump(spark: SparkSession, path: str, schema, keys: Keys, n: int, size: int = 10) -> DataFrame:
    """Page ``n`` (0-based) of ``size`` rows of the list laid out under ``path``: the same rows as ``filters.page``.

    ``schema`` is the list's. The scan is pruned to the parts in which the page
    lies, and a task keeps no more rows than its part has.
    """
    if n < 0 or size <= 0:
        raise ValueError("page number must be >= 0 and size > 0")
    counts = {r[PART]: r["n"] for r in spark.read.schema(f"{PART} int, n long").parquet(f"{path}/counts").collect()}
    start, hit, before = n * size, [], 0
    skip = 0
    for part in sorted(counts):
        if before < start + size and before + counts[part] > start:
            if not hit:
                skip = start - before
            hit.append(part)
        before += counts[part]
    names = [f.name for f in schema.fields]
    rows = spark.read.schema(f"{schema.toDDL()}, {PART} int").parquet(f"{path}/rows")
    rows = rows.where(F.col(PART).isin(hit) if hit else F.lit(False)).select(*names)
    return order(rows, keys).offset(skip).limit(size)


def number_of_rows(spark: SparkSession, path: str) -> int:
    """A3 of the list, from its parts' counts."""
    return spark.read.schema(f"{PART} int, n long").parquet(f"{path}/counts").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
