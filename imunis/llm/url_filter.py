"""URL filter by host and path rules, as a sort-merge range join. DataFrame functions only.

A rule (host, path) becomes an interval of canonical keys: the reversed host
(``org.example``), a separator byte, the path; every key that starts with the
rule's key lies between it and the key followed by 0xFF. A url gives one point
for each of its host's ancestors that the rules are deep enough to name. A
sweep over the sorted keys keeps a stack of the rules that are open; the top
of the stack at a point is the longest rule of that host that fits.

Intervals nest only inside one host, so the sweep runs by (host, salt): the
points of a host are dealt over as many salts as its count asks for and the
host's few interval ends are repeated for each. The stack itself is worked out
once, on the rules: slot n holds the latest rule opened at depth n.

Defined results
  null url, no "://"  host and path empty, no rule, the default verdict.
  empty path          no rule whose path is longer than nothing fits.
  several rules fit   the longest host + path wins, then the longer host.
  the same rule twice with two verdicts: block wins.
  empty rule host     fits only urls whose host is empty.
  repeated rows       each gives its own result row; null page_id likewise.
  empty tables        no pages: no rows; no rules: the default verdict.
  other columns       are not read; the result has only the columns listed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imunis.llm.common import lower_ascii, materialize

#: (verdict, host, path) of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    after = F.regexp_replace(_rest(url), r"^[^/?#]*", "")
    return F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _key(rev: Column, path: Column) -> Column:
    """Bytes that sort by reversed host, then path. Neither 0xFE nor 0xFF occurs in UTF-8."""
    return F.concat(F.encode(rev, "UTF-8"), F.unhex(F.lit("FE")), F.encode(path, "UTF-8"))


def segments(rules: DataFrame) -> DataFrame:
    """(rev, key, top): from ``key`` on, up to the next key of the same reversed host, ``top`` is the open rule."""
    distinct = (rules.select(lower_ascii("host").alias("host"), "path", "verdict")
                .filter("host is not null and path is not null and verdict is not null")
                .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
                .withColumn("rev", _reversed_host(F.split("host", r"\."))))
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                    F.concat("host", "path").alias("rule"), F.col("verdict"))
    ends = distinct.withColumn("key", _key(F.col("rev"), F.col("path"))).select(
        "rev", F.explode(F.array(
            F.struct(F.col("key").alias("key"), F.lit(1).alias("step"), rule.alias("rule")),
            F.struct(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(_RULE).alias("rule")),
        )).alias("e")).select("rev", "e.*")
    order = Window.partitionBy("rev").orderBy("key")
    depth = ends.withColumn("depth", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    slot = Window.partitionBy("rev", "depth").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(F.col("depth") > 0, F.last("rule", ignorenulls=True).over(slot))
    return depth.select("rev", "key", top.alias("top"))


_RULE = "struct<size:int,host_size:int,rule:string,verdict:string>"


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
                url_col: str = "url", points_per_group: int = 500_000) -> DataFrame:
    """Judge every url of ``pages`` by ``rules`` (verdict, host, path).

    Returns page_id, host, path, rule (host + path of the winner or null) and
    verdict (the winner's or ``default``), one row for each input row.
    ``points_per_group`` bounds the points that one sweep sorts.
    """
    base = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path"))
    ends = materialize(segments(rules), "url-rules")
    depth = ends.agg(F.max(F.size(F.split("rev", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    # Ancestors deeper than any rule's host can match none, so they get no point.
    levels = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1))))
    points = base.select(
        "page_id", "host", "path",
        F.explode(F.transform(levels, lambda n: F.array_join(F.slice(F.reverse(labels), 1, n), "."))).alias("rev"))
    hosts = ends.select("rev").distinct()
    counts = materialize(
        points.groupBy("rev").agg(F.count(F.lit(1)).alias("n")).join(hosts, "rev")
        .select("rev", F.ceil(F.col("n") / points_per_group).cast("int").alias("salts")), "url-salts")
    dealt = (points.join(counts, "rev")
             .select("rev", F.pmod(F.xxhash64("page_id", "host", "path"), F.col("salts")).cast("int").alias("salt"),
                     _key(F.col("rev"), F.col("path")).alias("key"), F.lit(True).alias("point"),
                     F.lit(None).cast(_RULE).alias("top"), "page_id", "host", "path"))
    bounds = (ends.join(counts, "rev")
              .select("rev", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key",
                      F.lit(False).alias("point"), "top", F.lit(None).cast(base.schema["page_id"].dataType).alias("page_id"),
                      F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")))
    # An interval's start comes before a point with the same key. The box keeps "no rule open" apart from "a point".
    sweep = (Window.partitionBy("rev", "salt").orderBy("key", "point")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    box = F.when(~F.col("point"), F.struct("top"))
    hits = (dealt.unionByName(bounds).withColumn("open", F.last(box, ignorenulls=True).over(sweep))
            .filter("point and open.top is not null").select("page_id", "host", "path", F.col("open.top").alias("top"),
                                                             F.lit(0).alias("n")))
    plain = base.select("page_id", "host", "path", F.lit(None).cast(_RULE).alias("top"), F.lit(1).alias("n"))
    return (plain.unionByName(hits).groupBy("page_id", "host", "path")
            .agg(F.max("top").alias("top"), F.sum("n").alias("n"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select("page_id", "host", "path", F.col("top.rule").alias("rule"),
                    F.coalesce("top.verdict", F.lit(default)).alias("verdict")))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


_CASES = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", v, h + p)
          for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
             FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut)
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, _, r in _CASES)} END AS rule,
       CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, v, _ in _CASES)} ELSE 'allow' END AS verdict
FROM parts
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every url of ``pages`` by ``RULES``."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))
