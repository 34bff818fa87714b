"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from imunis.llm import (bpe, chat_format, class_lm, collocations, decontaminate, exact_dedup, jaccard_join, language_id, pii, substring_dedup,
                        token_alignment, token_counts, url_filter)
from imunis.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]


def shipped(query: Query) -> Query:
    """The query, with this package sent to the executors first."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES: dict[str, Query] = {
    "op1_url_filter": shipped(url_filter.query),
    "op2_decontaminate": shipped(decontaminate.query),
    "op3_substring_dedup": shipped(substring_dedup.query),
    "op4_jaccard_join": shipped(jaccard_join.query),
    "op5_pii": shipped(pii.query),
    "op6_language_id": shipped(language_id.query),
    "op7_bpe": shipped(bpe.query),
    "op8_token_counts": shipped(token_counts.query),
    "op9_exact_dedup": shipped(exact_dedup.query),
    "op10_chat_format": shipped(chat_format.query),
    "op11_token_alignment": shipped(token_alignment.query),
    "op12_class_lm": shipped(class_lm.query),
    "op13_collocations": shipped(collocations.query),
}

ORACLE: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_chat_format": chat_format.SQL,
}
