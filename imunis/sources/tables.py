"""Loading, views, lookups and versioned snapshots."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one table with its declared schema (no inference)."""
    return spark.read.schema(TABLES[table].schema).parquet(path)


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Expose a table dict as temp views so ``param_lookup`` can query it."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def param_lookup(spark: SparkSession, query: str, params: Mapping[str, object] | None = None,
                 **frames: DataFrame) -> DataFrame:
    """Parametrised SQL to a DataFrame.

    Parameters are bound by name (``:name``), never pasted into the text;
    ``{name}`` stands for a DataFrame given by keyword, so no view is needed.
    Errors are raised to the caller instead of being turned into an empty
    result.
    """
    return spark.sql(query, args=dict(params or {}), **frames)


_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def table_exists(spark: SparkSession, name: str) -> bool:
    """Catalog existence check on the lower-cased name."""
    if not _NAME.match(name):
        return False
    return spark.catalog.tableExists(name.lower())


# One row for each committed version of a table: who committed it, and the last id handed out, if that is tracked.
MANIFEST = "_manifest"
MANIFEST_SCHEMA = "name string, version long, run string, last_id long"


def _at(root: str, *parts: object) -> str:
    return "/".join([root.rstrip("/"), *map(str, parts)])


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The committed versions under ``root`` (no rows if nothing was committed).

    Written and read by Spark, so ``root`` may be any path that Spark knows.
    """
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(_at(root, MANIFEST))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def commit(spark: SparkSession, root: str, rows: list[tuple[str, int, str | None, int | None]]) -> None:
    """Append manifest rows as one file, which appears whole or not at all."""
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(_at(root, MANIFEST))


def _refuse_committed(spark: SparkSession, root: str, names: list[str], version: int) -> None:
    done = manifest(spark, root).where((F.col("version") == version) & F.col("name").isin(names)).first()
    if done is not None:
        raise ValueError(f"version {version} of {done['name']} under {root} is committed")


def write_snapshot(df: DataFrame, root: str, table: str, version: int, mode: str = "errorifexists") -> str:
    """Write a new version of ``table`` under ``root/table/v=<version>``
    and commit it.

    A committed version is never overwritten (ValueError); readers pick the
    newest committed version with ``latest_snapshot``.
    """
    _refuse_committed(df.sparkSession, root, [table], version)
    path = _at(root, table, f"v={version}")
    df.write.mode(mode).parquet(path)
    commit(df.sparkSession, root, [(table, version, None, None)])
    return path


def snapshot_versions(spark: SparkSession, root: str, table: str) -> list[int]:
    rows = manifest(spark, root).where(F.col("name") == table).select("version").distinct().collect()
    return sorted(r["version"] for r in rows)


def latest_snapshot(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    versions = snapshot_versions(spark, root, table)
    if not versions:
        return None
    return read_table(spark, _at(root, table, f"v={versions[-1]}"), table)


def commit_batch(root: str, version: int, new_state: Mapping[str, DataFrame], decisions: DataFrame) -> dict[str, str]:
    """S7 for a change batch: write every table the batch changed and its
    decisions as version ``version`` under ``root``, then one manifest file
    that names them all. Readers only see versions in the manifest, so a
    batch that dies half-way is invisible in every table at once; rerunning
    it overwrites only its own uncommitted folders, and a committed version is
    refused (ValueError). The operator keeps its judgement in a checkpoint, so
    writing several tables judges once."""
    if version == 0:
        raise ValueError("version 0 is the initial snapshot")
    _refuse_committed(decisions.sparkSession, root, [*new_state, "decisions"], version)
    out = {}
    for name, df in {**new_state, "decisions": decisions}.items():
        out[name] = _at(root, name, f"v={version}")
        df.write.mode("overwrite").parquet(out[name])
    commit(decisions.sparkSession, root, [(name, version, None, None) for name in out])
    return out


# ---- tables in parts: a small batch rewrites only the parts that it changes

#: Parts of a table; a row's part is a hash of its key.
PARTS = 64


def part_of(key: str, span: int | None = None) -> Column:
    """A row's part: a hash of its key, or, with ``span``, the range of ``span`` keys that holds it.

    Ranges suit tables with serial keys: a part has at most ``span`` rows however
    large the table gets, and new rows fall into the last parts alone.
    """
    if span is not None:
        return F.expr(f"CAST(`{key}` AS BIGINT) DIV {int(span)}")
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(PARTS)).cast("int")


def parts_hit(rows: DataFrame, key: str, span: int | None = None) -> list[int]:
    """The parts in which keys of ``rows`` lie: at most ``PARTS`` numbers, or with ``span`` one for each range hit."""
    return sorted(r[0] for r in rows.where(F.col(key).isNotNull()).select(part_of(key, span)).distinct().collect())


def write_parts(df: DataFrame, root: str, table: str, version: int, parts: list[int] | None = None,
                span: int | None = None) -> list[tuple]:
    """Write the given (or all) parts of ``table`` under ``root/table/v=<version>/part=<n>``, one task each.

    Returns the manifest rows that make them visible; the caller commits them
    with the rest of its batch. Parts that are not written stay as they are,
    so the version's cost follows the parts that changed.
    """
    key = TABLES[table].key[0]
    if parts is None:
        parts = list(range(PARTS)) if span is None else parts_hit(df, key, span)
    if parts:
        df.withColumn("part", part_of(key, span)).where(F.col("part").isin(parts)).repartition(len(parts), "part") \
            .write.mode("overwrite").partitionBy("part").parquet(_at(root, table, f"v={version}"))
    return [(f"{table}/part={p}", version, None, None) for p in parts]


def read_parts(spark: SparkSession, root: str, table: str, parts: list[int] | None = None) -> DataFrame:
    """The newest committed version of each (or each given) part, as one table."""
    mine = F.col("name").startswith(f"{table}/part=") if parts is None else F.col("name").isin([f"{table}/part={p}" for p in parts])
    newest = manifest(spark, root).where(mine).groupBy("name").agg(F.max("version").alias("v")).collect()
    paths = [_at(root, table, f"v={r['v']}", r["name"].split("/")[1]) for r in newest]
    schema = TABLES[table].schema
    # A part without rows has no folder.
    paths = [p for p in paths if _there(spark, p)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
