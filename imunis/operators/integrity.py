"""Integrity audits over whole tables (K1, K2, K4, K6).

Parquet enforces none of the DDL's constraints, so these jobs report what
PostgreSQL would have refused. Each audit reads every table once and returns
aggregated findings (one row per offending key or per column and rule), so
its output is bounded by the number of distinct offending values and a hot
key costs one row, not one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import TABLES, TIPOS_VACINA

Tables = Mapping[str, DataFrame]


def _key_text(cols) -> F.Column:
    if len(cols) == 1:
        return F.col(cols[0]).cast("string")
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def audit_pk(t: Tables) -> DataFrame:
    """K1: primary-key values that occur more than once (or are NULL)."""
    out = []
    for name, spec in TABLES.items():
        if name not in t:
            continue
        g = t[name].groupBy(*spec.key).agg(F.count(F.lit(1)).alias("n_rows"))
        bad = g.where((F.col("n_rows") > 1) | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in spec.key]))
        out.append(bad.select(F.lit(name).alias("table_name"), _key_text(spec.key).alias("key_value"), "n_rows"))
    return _union(out)


def audit_fk(t: Tables) -> DataFrame:
    """K2: child values with no parent row, per foreign key, with their row count.

    Each child table is read once: its foreign-key columns are unpivoted to
    (key number, number, text) rows, each value in its own type and nothing
    else, and counted (map-side partial aggregation, so a value held by a third
    of the rows costs one row per task). The counts of all tables are
    anti-joined in one join with the key sets of the referenced tables (each
    built once). Names and the text form of a value are put on what is left,
    the orphans.
    """
    refs: dict[tuple[str, str], int] = {}
    named, counts, parents = [], [], []
    for name, spec in TABLES.items():
        fks = [fk for fk in spec.foreign_keys if name in t and fk.ref_table in t]
        stacked = []
        for fk in fks:
            col, ref = fk.columns[0], (fk.ref_table, fk.ref_columns[0])
            if ref not in refs:
                refs[ref] = len(refs)
                parents.append(t[ref[0]].select(F.lit(refs[ref]).alias("ref"), *_typed(t[ref[0]], ref[1])))
            text = dict(t[name].dtypes)[col] == "string"
            stacked.append(f"{len(named)}, {refs[ref]}, " + (f"CAST(NULL AS BIGINT), `{col}`" if text
                                                           else f"CAST(`{col}` AS BIGINT), CAST(NULL AS STRING)"))
            named.append((len(named), name, col, fk.ref_table))
        if stacked:
            long = t[name].selectExpr(f"stack({len(stacked)}, {', '.join(stacked)}) AS (fk, ref, number, text)")
            counts.append(long.groupBy("fk", "ref", "number", "text").agg(F.count(F.lit(1)).alias("n_rows")))
    keys = _union(parents).where("number IS NOT NULL OR text IS NOT NULL").distinct()
    c, k = _union(counts).alias("c"), keys.alias("k")
    # A value sits in one of the two columns; the other is a constant, so plain equality decides.
    same = ((F.col("c.ref") == F.col("k.ref")) &
            (F.coalesce("c.number", F.lit(-1)) == F.coalesce("k.number", F.lit(-1))) &
            (F.coalesce("c.text", F.lit("")) == F.coalesce("k.text", F.lit(""))) &
            (F.col("c.number").isNotNull() | F.col("c.text").isNotNull()))
    orphans = c.join(k, same, "left_anti")
    what = F.create_map(*[x for n, table, col, ref in named
                          for x in (F.lit(n), F.struct(F.lit(table).alias("t"), F.lit(col).alias("c"), F.lit(ref).alias("r")))])
    name_of = F.element_at(what, F.col("fk"))
    return orphans.select(name_of["t"].alias("table_name"), name_of["c"].alias("fk_columns"), name_of["r"].alias("ref_table"),
                          F.coalesce(F.col("number").cast("string"), F.col("text")).alias("fk_value"), "n_rows")


def _typed(df: DataFrame, col: str) -> list[F.Column]:
    """(number, text) of a key column: one of them holds it, in its own type."""
    if dict(df.dtypes)[col] == "string":
        return [F.lit(None).cast("bigint").alias("number"), F.col(col).alias("text")]
    return [F.col(col).cast("bigint").alias("number"), F.lit(None).cast("string").alias("text")]


def _per_column_counts(df: DataFrame, table: str, checks: list[tuple[str, str, F.Column]]) -> DataFrame:
    """One pass over ``df`` computing every (column, rule) violation count,
    then unpivoted to rows (table_name, column_name, rule, n_violations)."""
    aggs = [F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(f"c{i}") for i, (_, _, cond) in enumerate(checks)]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{col}', '{rule}', c{i}" for i, (col, rule, _) in enumerate(checks))
    return wide.selectExpr(f"stack({len(checks)}, {pairs}) AS (column_name, rule, n_violations)") \
        .select(F.lit(table).alias("table_name"), "column_name", "rule", "n_violations")


def audit_columns(t: Tables) -> DataFrame:
    """K4: NOT NULL and VARCHAR(n) violations per column (zero counts kept)."""
    out = []
    for name, spec in TABLES.items():
        if name not in t:
            continue
        checks = [(c, "not_null", F.col(c).isNull()) for c in spec.not_null]
        checks += [(c, f"max_length_{n}", F.char_length(c) > n) for c, n in spec.lengths.items()]
        out.append(_per_column_counts(t[name], name, checks))
    return _union(out)


# Widget ranges of the reference's forms (K6).
RANGE_RULES = {
    "vacina": [
        ("codigo_lote", "non_negative_integer", lambda: ~F.coalesce(F.col("codigo_lote").rlike("^[0-9]+$"), F.lit(False))),
        ("qtd_doses", "min_0", lambda: F.col("qtd_doses") < 0),
    ],
    "local": [
        ("numero", "min_1", lambda: F.col("numero") < 1),
        ("capacidade", "min_0", lambda: F.col("capacidade") < 0),
        ("estado", "max_length_2", lambda: F.char_length("estado") > 2),
    ],
    "vacinacao": [
        ("contagem", "min_1", lambda: F.col("contagem") < 1),
    ],
    "campanha": [
        ("tipo_vacina", "in_options", lambda: ~F.col("tipo_vacina").isin(*TIPOS_VACINA)),
    ],
}


def range_conditions(table: str) -> list[tuple[str, str, F.Column]]:
    return [(c, r, f()) for c, r, f in RANGE_RULES.get(table, [])]


def audit_ranges(t: Tables) -> DataFrame:
    """K6: values outside what the forms' widgets allow (zero counts kept)."""
    out = [_per_column_counts(t[name], name, range_conditions(name)) for name in RANGE_RULES if name in t]
    return _union(out)
