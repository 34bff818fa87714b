"""A training-data pipeline over ``documents``, of the operators in ``imunis.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``; the last returns the encoded documents.

  language_id     documents whose language is rejected go (no letters, no text,
                  or a score below the calibrated threshold)
  exact_dedup     of equal texts one document stays
  jaccard_join    of each group of near copies (five words, 80 percent) one stays
  decontaminate   documents that cover a benchmark item go
  bpe             the rest is encoded

A null text has no letters and goes in the first stage, and an empty table gives
empty results. Rows that repeat a doc_id are dropped where their texts are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from imunis.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from imunis.llm.common import materialize, ship

#: Threshold of the near-copy stage: words of a shingle, percent of similarity.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.identified(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.keep_one(docs, index)
    index.close()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the trained classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
