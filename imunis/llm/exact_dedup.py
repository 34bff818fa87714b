"""Exact deduplication against a persistent digest index. DataFrame functions only.

The index is a Parquet table bucketed and sorted by digest, so the anti-join
that looks up new digests reads it without a shuffle: only the new digests,
one row each after aggregation, move. Rows are never grouped as such: copies
are counted with map-side aggregation, and verdicts go back to the rows by a
join of two materialised tables, whose skewed keys AQE splits.

Defined results
  null text     counts as the empty text; all such rows are copies of it.
  null doc_id   sorts below every id; it stays only if its group has no other.
  repeated rows same doc_id and equal text: group_size counts each, one stays.
  ties          cannot occur beyond repeated rows.
  empty table   gives an empty result and leaves the index as it is.
  other columns are not read; the result has only the columns listed.

A batch may be run again. Digests are stored with the batch that brought them,
and a batch ignores its own: if the driver dies behind the append, the rerun
gives the same verdicts and appends only what is missing. A batch is named by
the caller, or by a fingerprint of its rows (ids and texts).
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imunis.llm.common import NULL_ID, lower_ascii, materialize, scratch


def digest(text: Column | str) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(lower_ascii(F.coalesce(col, F.lit(""))), 256))


class DigestIndex:
    """A folder of digests already accepted, with the id that was kept for each and the batch that brought it.

    ``path`` must be shared storage. Opening an existing folder registers it
    again, so that the index outlives the session. The number of buckets is
    kept in the folder; another one is refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        try:
            kept = spark.read.schema("buckets int").json(f"{path}/_layout").first()["buckets"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            kept = buckets
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/_layout")
        if kept != buckets:
            raise ValueError(f"the index at {path} has {kept} buckets, not {buckets}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add the (digest, keep_id) rows that the index does not have from this batch, laid out by bucket so that
        each task writes whole buckets."""
        mine = self.read().filter(F.col("batch") == batch).select("digest").hint("merge")
        (rows.select("digest", "keep_id").join(mine, "digest", "left_anti").withColumn("batch", F.lit(batch))
         .repartition(self.buckets, "digest").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def close(self) -> None:
        """Take the table out of the session's catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def fingerprint(rows: DataFrame) -> str:
    """A name for a batch of (digest, doc_id, copies), whatever the rows' order."""
    h = F.sha2(F.concat_ws(":", F.hex("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "copies"), 256)
    part = lambda k: F.conv(F.substring(h, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(part(k)) for k in range(4)]).first()
    return hashlib.sha256(":".join(map(str, sums)).encode()).hexdigest()


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text",
                batch: str | None = None) -> DataFrame:
    """Judge every row of ``docs`` and append the new digests to ``index``.

    Returns doc_id, keep_id, group_size, kept, text_sha256 and seen_before,
    one row for each input row. Of equal texts the largest id stays; a text
    that the index already holds from another batch keeps the id it was
    accepted with and none of its new rows stay. ``group_size`` counts the rows
    of this batch.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    rows = materialize(slim.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digests")
    batch = batch or fingerprint(rows)
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    known = index.read().filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id")).hint("merge")
    fresh = groups.join(known, "digest", "left_anti").withColumn("seen_before", F.lit(False))
    seen = (groups.join(known, "digest")
            .select("digest", F.col("known_id").alias("keep_id"), "group_size", F.lit(True).alias("seen_before")))
    judged = materialize(fresh.unionByName(seen), "judged")
    index.append(judged.filter(~F.col("seen_before")), batch)
    stays = ~F.col("seen_before") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return (rows.join(judged, "digest")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "keep_id", "group_size",
                    (stays & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "seen_before"))


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the session's scratch folder, with a bucket for each shuffle partition."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"{scratch(spark)}/digest-index-{uuid.uuid4().hex[:12]}", buckets)


def keep_one(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one for each new text."""
    judged = deduplicate(docs, index, id_col, text_col).filter("kept")
    stay = judged.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.unhex("text_sha256").alias("__digest"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "__digest": digest(F.col(text_col))})
    # Behind the join only rows equal in id and text are left together; the first of them stays, without another shuffle.
    joined = keyed.join(stay, ["__digest", "__id"], "left_semi").dropDuplicates(["__digest", "__id"])
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256, false AS seen_before
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
WINDOW w AS (PARTITION BY t)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all of ``documents`` against a new index."""
    index = new_index(spark)
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), index, batch="all")
    index.close()
    return out
