"""Token budgets for every context limit, from an exact histogram of encoded lengths.

Documents are encoded with the BPE of ``bpe``; only their lengths are kept and
aggregated at once (map-side), so what is shuffled is one row for each distinct
length and task. All answers are suffix sums over the histogram:

  docs_over(L)       documents longer than L
  tokens_over(L)     their tokens
  truncated(L)       tokens left when every document is cut at L tokens
                     = total - tokens_over(L) + L * docs_over(L)
  quantile           share of documents that are not longer than L

Suffix sums are taken in two levels, blocks of lengths and lengths in a block,
so that no single task sees the whole histogram.

Defined results: null and empty texts have length 0; repeated rows each count;
null ids make no difference; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imunis.llm.bpe import default_vocabulary, load
from imunis.llm.common import materialize

#: Distinct lengths that one task sums up.
BLOCK = 4096


def histogram(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for at in range(0, len(texts), 512):
                lengths = [len(ids) // 4 for ids in bpe.encode_batch(texts[at:at + 512])]
                yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], names=["n_tokens"])

    return (docs.select(F.col(text_col)).mapInArrow(run, "n_tokens long")
            .groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The answers at each length that occurs; between two such lengths see ``at_limits``.

    Returns n_tokens, n_docs, docs_over, tokens_over, total_docs, total_tokens,
    truncated_tokens and quantile.
    """
    blocked = materialize(hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "length-histogram")
    sums = blocked.groupBy("block").agg(
        F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    # A row for each block of lengths: as many as the longest document has blocks.
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = sums.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")],
                        *[F.sum(c).over(every).alias(f"total_{c}") for c in ("docs", "tokens")])
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("n_docs") * F.col("n_tokens")
    return (blocked.withColumn("own_docs", F.coalesce(F.sum("n_docs").over(inner), F.lit(0)))
            .withColumn("own_tokens", F.coalesce(F.sum(own).over(inner), F.lit(0)))
            .join(later, "block")
            .withColumn("docs_over", F.col("own_docs") + F.col("later_docs"))
            .withColumn("tokens_over", F.col("own_tokens") + F.col("later_tokens"))
            .select("n_tokens", "n_docs", "docs_over", "tokens_over", "total_docs", "total_tokens",
                    (F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over"))
                    .alias("truncated_tokens"),
                    (1 - F.col("docs_over") / F.col("total_docs")).alias("quantile")))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Answers at any context limits, from the result of ``suffix_sums``.

    (limit, docs_over, tokens_over, truncated_tokens), one row for each given
    limit; the histogram's rows are read once for each.
    """
    each = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))]))
    over = F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)
    return sums.select("n_tokens", "n_docs", each.alias("limit")).groupBy("limit").agg(
        F.sum(over).alias("docs_over"), F.sum(over * F.col("n_tokens")).alias("tokens_over"),
        F.sum(F.col("n_docs") * F.least("n_tokens", "limit")).alias("truncated_tokens"))


def length_at(sums: DataFrame, share: float) -> DataFrame:
    """The shortest context limit that holds ``share`` of the documents whole, as one row (n_tokens)."""
    return sums.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every encoded length of ``documents`` with its suffix sums."""
    return suffix_sums(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
