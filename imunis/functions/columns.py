"""Column expressions used by the lists, rules and change operators.

All are built-in ``pyspark.sql.functions`` expressions, so they stay inside
whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schemas import ROLE_ADMIN, ROLE_AGENTE, ROLE_CIDADAO, ROLE_GENERICO

DISPLAY_DATE = "dd/MM/yyyy"
OPEN_END = "9999-12-31"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def role(cidadao_key, admin_key, agente_key) -> Column:
    """First matching role wins — Cidadão > Administrador > Agente > generic."""
    return (
        F.when(_c(cidadao_key).isNotNull(), F.lit(ROLE_CIDADAO))
        .when(_c(admin_key).isNotNull(), F.lit(ROLE_ADMIN))
        .when(_c(agente_key).isNotNull(), F.lit(ROLE_AGENTE))
        .otherwise(F.lit(ROLE_GENERICO))
    )


def format_date(col) -> Column:
    """DATE -> 'dd/MM/yyyy' text; NULL stays NULL."""
    return F.date_format(_c(col), DISPLAY_DATE)


def parse_date(col) -> Column:
    """P4: 'd/M/yyyy' text -> DATE, else 'yyyy-M-d', else NULL; zeros in front of day and month may be left out.

    ``try_to_date`` keeps bad text (``31/02/2025``) from failing the job under
    ANSI mode.
    """
    c = F.trim(_c(col))
    return F.coalesce(F.try_to_date(c, "d/M/yyyy"), F.try_to_date(c, "yyyy-M-d"))


def label_vacina_stock(nome, lote, doses) -> Column:
    """P5: 'nome (Lote: x, Doses: n)' (dose form)."""
    return F.format_string("%s (Lote: %s, Doses: %s)", _c(nome), _c(lote), _c(doses))


def label_vacina(nome, lote) -> Column:
    """P5: 'nome (Lote: x)' (appointment form)."""
    return F.format_string("%s (Lote: %s)", _c(nome), _c(lote))


def label_local(nome, cidade) -> Column:
    """P5: 'nome (cidade)'."""
    return F.format_string("%s (%s)", _c(nome), _c(cidade))


def label_campanha_id(nome, id_campanha) -> Column:
    """P5: 'nome (ID: n)' (dose form); the appointment form shows the name only."""
    return F.format_string("%s (ID: %s)", _c(nome), _c(id_campanha))


def label_cidadao(nome, cpf) -> Column:
    """P5: 'nome (cpf)'."""
    return F.format_string("%s (%s)", _c(nome), _c(cpf))


# White space that the form strips: Unicode's, plus the four separator controls.
_WS = r"[\s\x1c-\x1f]"


def strip_ws(col) -> Column:
    """Remove all leading and trailing white space (tabs, newlines and
    Unicode spaces too)."""
    return F.regexp_replace(_c(col), rf"(?U)^{_WS}+|{_WS}+$", "")


def positive_or_null(col) -> Column:
    """Zero or negative capacity is stored as NULL."""
    return F.when(_c(col) > 0, _c(col)).cast("int")


def null_as_zero(col) -> Column:
    """NULL capacity reads as 0."""
    return F.coalesce(_c(col), F.lit(0))


def capitalize(col) -> Column:
    """First character upper, the rest lower (one word rule, not initcap)."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def missing_text(col) -> Column:
    """F10 for text: NULL or empty is missing (Python truth)."""
    return _c(col).isNull() | (_c(col) == F.lit(""))


def missing_int(col) -> Column:
    """F10 for integers: NULL or 0 is missing (Python truth)."""
    return _c(col).isNull() | (_c(col) == F.lit(0))


def missing_date(col) -> Column:
    return _c(col).isNull()


def in_period(day, inicio, fim) -> Column:
    """V5: inicio <= day <= fim, open end when fim is NULL."""
    return _c(day).between(_c(inicio), F.coalesce(_c(fim), F.lit(OPEN_END).cast("date")))
