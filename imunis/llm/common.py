"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imunis.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null id in internal keys, so that it is a key like any other.
NULL_ID = -(2**63)

_FOLDERS: dict[str, str] = {}


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; the folder stays with the checkpoints
        pass


def scratch(spark: SparkSession) -> str:
    """This session's folder inside the shared checkpoint folder; removed when the driver ends."""
    key = spark.sparkContext.applicationId
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{key}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _FOLDERS[key])
    return _FOLDERS[key]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application, so that their tasks can import it."""
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="imunis-ship-"), "imunis.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("imunis", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(key)


def materialize(df: DataFrame, label: str, slim: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage (a lost executor costs no more than the tasks it ran),
    fixes what later steps read, and gives later joins an input without a
    partitioning of its own, so that AQE may split skewed keys on both sides.
    ``slim`` tables, of a few numbers a row, are written by an eighth of the
    tasks that the session shuffles to.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    if slim:
        written = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    else:
        written = df
    written.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, folder)


def lower_ascii(col: Column | str) -> Column:
    """A-Z to a-z, every other character as it is; null stays null."""
    return F.translate(F.col(col) if isinstance(col, str) else col, UPPER, UPPER.lower())
