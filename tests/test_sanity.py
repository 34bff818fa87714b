"""Whole-table counts at sf0.001 as regression goldens, counted by the SQL of
each query in DuckDB (`tools/oracle_check.py`)."""

import pytest

import __spark_entry__ as E

from paths import SF_SMALL

Q = E.queries()


def n(spark, name, where=None):
    df = Q[name](spark, SF_SMALL)
    return (df.where(where) if where else df).count()


def test_list_counts(spark):
    assert n(spark, "vacinas_validas") == 49  # 45 lots and 4 spare ones
    assert n(spark, "campanhas_ativas") == 10
    assert n(spark, "agendamentos") == 1971
    assert n(spark, "vacinacoes") == 1745
    assert n(spark, "parentescos") == 90


def test_roles_slots_period(spark):
    roles = {r["tipo_usuario"]: r["n_usuarios"] for r in Q["role_counts"](spark, SF_SMALL).collect()}
    assert roles == {"Cidadão": 105, "Administrador": 15, "Agente de Saúde": 15, "Usuário Genérico": 15}
    assert n(spark, "slot_availability") == 447
    assert n(spark, "slot_availability", "full") == 181
    assert n(spark, "campaign_period_check", "ok") == 528


def test_dose_batch_outcomes(spark):
    got = {r["reason"]: r["count"] for r in Q["vacinacao_insert"](spark, SF_SMALL).groupBy("reason").count().collect()}
    assert got == {None: 1024, "not_citizen": 659, "no_stock": 167, "fk_violation": 82, "not_null": 24, "missing_field": 26,
                   "out_of_range": 40}
