"""Filter operators (F1–F7) and ordering / paging (O1–O3).

Blank filter values are dropped, and no filter at all returns the input
unchanged (F2). Every predicate is a built-in expression, so Catalyst pushes
key and date predicates into the scans and runs text predicates right after
them (and below joins when the column comes from one join side).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DateLike = dt.date | str | Column | None


def _blank(v) -> bool:
    return v is None or (isinstance(v, str) and v == "")


def _and(preds: Sequence[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, preds) if preds else None


def _date(v: DateLike) -> Column:
    if isinstance(v, Column):
        return v
    return F.lit(v if isinstance(v, dt.date) else str(v)).cast("date")


def apply_all(df: DataFrame, preds: Sequence[Column]) -> DataFrame:
    p = _and(list(preds))
    return df if p is None else df.where(p)


def like_pattern(text: str) -> str:
    """``%text%`` as a LIKE pattern with PostgreSQL's backslash rule: a
    backslash makes the next character literal. The rule holds for the whole
    pattern, so a backslash that ends the text makes the closing ``%`` literal.
    Spark accepts only ``\\%``, ``\\_`` and ``\\\\``, so other escapes are
    written as the bare character."""
    pattern = f"%{text}%"

    def literal(m: re.Match) -> str:
        return m[0] if m[1] in "%_\\" else m[1]

    return re.sub(r"\\(.)", literal, pattern, flags=re.S)


def like_predicates(filters: Mapping[str, str | None]) -> list[Column]:
    """``col ILIKE '%text%'`` per non-blank entry; ``%`` and ``_`` stay wildcards."""
    return [F.col(c).ilike(like_pattern(t)) for c, t in filters.items() if not _blank(t)]


def filter_like(df: DataFrame, filters: Mapping[str, str | None]) -> DataFrame:
    """F1 + F2: AND of case-insensitive LIKE filters."""
    return apply_all(df, like_predicates(filters))


def regex_contains(col, pattern: str, case_sensitive: bool = False, literal: bool = False) -> Column:
    """regular-expression search anywhere in the text; NULL counts as no match.

    ``literal=True`` quotes the text so it is matched as typed. ``\\w``,
    ``\\d``, ``\\s`` and ``\\b`` know all of Unicode (``(?U)``).
    """
    c = F.col(col) if isinstance(col, str) else col
    pat = _quote(pattern) if literal else pattern
    pat = ("(?U)" if case_sensitive else "(?iuU)") + pat
    return F.coalesce(c.rlike(pat), F.lit(False))


def _quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def filter_regex(df: DataFrame, filters: Mapping[str, str | None],
                 case_sensitive: Iterable[str] = ()) -> DataFrame:
    """AND of regex filters; columns in ``case_sensitive`` match case."""
    cs = set(case_sensitive)
    return apply_all(df, [regex_contains(c, t, c in cs) for c, t in filters.items() if not _blank(t)])


def filter_any(df: DataFrame, groups: Sequence[tuple[Sequence[str], str | None, bool]]) -> DataFrame:
    """each group is (columns, text, case_sensitive); a row passes a group if
    any column matches; groups are ANDed. The text is stripped of white space
    first, as the form does."""
    preds = []
    for cols, text, cs in groups:
        if _blank(text):
            continue
        t = text.strip()
        if t == "":
            continue
        preds.append(reduce(lambda a, b: a | b, [regex_contains(c, t, cs) for c in cols]))
    return apply_all(df, preds)


def range_predicates(col: str, lo: DateLike = None, hi: DateLike = None) -> list[Column]:
    """inclusive range, either end optional."""
    out = []
    if lo is not None:
        out.append(F.col(col) >= _date(lo))
    if hi is not None:
        out.append(F.col(col) <= _date(hi))
    return out


def filter_range(df: DataFrame, col: str, lo: DateLike = None, hi: DateLike = None) -> DataFrame:
    return apply_all(df, range_predicates(col, lo, hi))


def active_predicate(as_of: DateLike = None) -> Column:
    """campaign running on ``as_of`` (open end allowed)."""
    day = F.current_date() if as_of is None else _date(as_of)
    return (F.col("data_fim").isNull() | (F.col("data_fim") >= day)) & (F.col("data_inicio") <= day)


def campanhas_ativas(campanha: DataFrame, as_of: DateLike = None, ordered: bool = True) -> DataFrame:
    """F6 list: active campaigns, newest start first (id breaks ties)."""
    out = campanha.where(active_predicate(as_of)).select(
        "id_campanha", "nome", "doenca_alvo", "tipo_vacina", "data_inicio", "data_fim", "publico_alvo")
    return order(out, [("data_inicio", "desc"), ("id_campanha", "asc")]) if ordered else out


def unexpired_predicate(as_of: DateLike = None) -> Column:
    day = F.current_date() if as_of is None else _date(as_of)
    return F.col("data_validade") >= day


def vacinas_validas(vacina: DataFrame, as_of: DateLike = None, ordered: bool = True) -> DataFrame:
    """F7 list: lots not expired on ``as_of`` (stock is not looked at), by name."""
    out = vacina.where(unexpired_predicate(as_of)).select(
        "id_vacina", "nome", "doenca_alvo", "codigo_lote", "qtd_doses", "data_validade", "data_chegada")
    return order(out, [("nome", "asc"), ("id_vacina", "asc")]) if ordered else out


# -- ordering and paging -------------------------------------------------

def sort_key(col: str, direction: str = "asc") -> Column:
    """O1: PostgreSQL NULL placement — last when ascending, first when descending."""
    c = F.col(col)
    return c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last()


def order(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """O1/O2: mixed-direction sort; callers end ``keys`` with the primary key."""
    return df.orderBy(*[sort_key(c, d) for c, d in keys])


def page(df: DataFrame, keys: Sequence[tuple[str, str]], n: int, size: int = 10) -> DataFrame:
    """O3: page ``n`` (0-based) of ``size`` rows in the total order ``keys``.

    Sort + offset + limit plans as a per-partition top-(offset+size) followed
    by one small merge, not a full sort of the table.
    """
    if n < 0 or size <= 0:
        raise ValueError("page number must be >= 0 and size > 0")
    return order(df, keys).offset(n * size).limit(size)


def page_after(df: DataFrame, keys: Sequence[tuple[str, str]], last: Mapping[str, object], size: int = 10) -> DataFrame:
    """O3 for deep pages: the ``size`` rows that follow the row with the key
    values ``last`` in the total order ``keys``.

    A filter on the keys and a top-``size``: each task keeps ``size`` rows
    however deep the page is, where ``page`` keeps offset + size.
    """
    if size <= 0:
        raise ValueError("size must be > 0")
    after = F.lit(False)
    for col, direction in reversed(list(keys)):
        c, v = F.col(col), last[col]
        value = F.lit(v).cast(df.schema[col].dataType)
        if direction == "desc":  # NULL first, then falling values
            beyond = c.isNotNull() if v is None else c < value
        else:  # rising values, then NULL
            beyond = F.lit(False) if v is None else (c.isNull() | (c > value))
        after = F.coalesce(beyond, F.lit(False)) | (c.eqNullSafe(value) & after)
    return order(df.where(after), keys).limit(size)


def result_count(df: DataFrame) -> DataFrame:
    """A3: number of rows of a (filtered) list, as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
