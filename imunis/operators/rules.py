"""Validation rules re-aimed at whole request tables.

The reference answers one question per call with a keyed lookup; here each
rule takes a DataFrame of requests and answers all of them with joins. Keys
of parent tables are unique (K1) and are joined as they are; keys out of child
tables are made distinct first (map-side partial aggregation). Both kinds of
join shuffle both sides afresh, so AQE can split a key that a large share of
the requests hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

OPEN_END = C.OPEN_END

# Messages of the reference's rules.
MSG_INVALID_CAMPAIGN = "Campanha inválida."
MSG_NOT_CITIZEN = "CPF não cadastrado como cidadão."
MSG_INVALID_VACCINE = "Vacina inválida."
MSG_NO_STOCK = "Vacina sem estoque disponível."
MSG_OUT_OF_PERIOD = "Data agendada fora do período da campanha."
MSG_NULL_CITY = "Erro na validação do cidadão: cidade não informada."
MSG_NOT_TARGET = "Cidadão de %s não se encaixa no público alvo da campanha (%s)."


def key_flag(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str, unique: bool = False) -> DataFrame:
    """Add boolean ``flag``: does the row's ``on`` tuple occur in ``keys``?

    Every input row comes out exactly once. ``unique=True`` is the caller's
    word that ``keys`` repeats no tuple (a parent table's key, K1); where that
    is broken a row comes out once for each repeat, so audit loaded tables with
    ``integrity.audit_pk`` first. Otherwise ``keys`` is made distinct,
    and the join gets a hash of the key as one more join column: the output
    of the aggregate is then not partitioned the way the join asks for, so
    the join shuffles it, and AQE's skew split, which needs a shuffle right
    below the join on both sides, stays possible.
    """
    on = list(on)
    if unique:
        k = keys.select(*on).withColumn(flag, F.lit(True))
        j = df.join(k, on, "left")
    else:
        k = keys.select(*on).distinct()
        k = k.withColumn("_kf_h", _key_hash(k, on)).withColumn(flag, F.lit(True))
        j = df.withColumn("_kf_h", _key_hash(df, on)).join(k, [*on, "_kf_h"], "left").drop("_kf_h")
    return j.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def _key_hash(df: DataFrame, on: Sequence[str]) -> F.Column:
    """Hash of a key; integers hash alike whatever their width."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    types = dict(df.dtypes)
    return F.xxhash64(*[F.col(c).cast("bigint") if types[c] in whole else F.col(c) for c in on])


def citizens(cidadao: DataFrame, usuario: DataFrame) -> DataFrame:
    """Citizen rows with their user name (the probe of V1/V7 is this join)."""
    return cidadao.join(usuario.select("cpf", "nome"), "cpf")


def eligibility(requests: DataFrame, campanha: DataFrame, cidadao: DataFrame, usuario: DataFrame) -> DataFrame:
    """V1 for every (cpf, id_campanha) request.

    Checks in order: unknown campaign; not a citizen; NULL city (reported,
    not raised); the lower-cased target audience must contain the lower-cased
    city or the word ``geral``.
    """
    camp = campanha.select("id_campanha", F.lower("publico_alvo").alias("_publico"), F.lit(True).alias("_camp"))
    cit = citizens(cidadao, usuario).select("cpf", F.lower("cidade").alias("_cidade"), F.lit(True).alias("_cit"))
    j = requests.join(camp, "id_campanha", "left").join(cit, "cpf", "left")
    fits = F.contains(F.col("_publico"), F.col("_cidade")) | F.contains(F.col("_publico"), F.lit("geral"))
    reason = (
        F.when(F.col("_camp").isNull(), F.lit("invalid_campaign"))
        .when(F.col("_cit").isNull(), F.lit("not_citizen"))
        .when(F.col("_cidade").isNull(), F.lit("error_null_city"))
        .when(~fits, F.lit("not_target"))
    )
    message = (
        F.when(F.col("_camp").isNull(), F.lit(MSG_INVALID_CAMPAIGN))
        .when(F.col("_cit").isNull(), F.lit(MSG_NOT_CITIZEN))
        .when(F.col("_cidade").isNull(), F.lit(MSG_NULL_CITY))
        .when(~fits, F.format_string(MSG_NOT_TARGET, C.capitalize("_cidade"), F.col("_publico")))
        .otherwise(F.lit(""))
    )
    return j.select(*requests.columns, reason.isNull().alias("ok"), reason.alias("reason"), message.alias("message"))


def stock_check(requests: DataFrame, vacina: DataFrame) -> DataFrame:
    """V2: the lot exists and has at least one dose."""
    v = vacina.select("id_vacina", "qtd_doses")
    j = requests.join(v, "id_vacina", "left")
    reason = (F.when(F.col("qtd_doses").isNull(), F.lit("invalid_vaccine"))
              .when(F.col("qtd_doses") <= 0, F.lit("no_stock")))
    return j.select(*requests.columns, reason.isNull().alias("ok"), reason.alias("reason"))


def bookings_per_site_day(agendamento: DataFrame) -> DataFrame:
    """A1/V4: appointments per (id_local, data_agendamento) for all pairs."""
    return agendamento.groupBy("id_local", "data_agendamento").agg(F.count(F.lit(1)).alias("n_agendamentos"))


def slot_availability(agendamento: DataFrame, local: DataFrame) -> DataFrame:
    """V3 + V4: booked, capacity (NULL/unknown -> 0), free seats and full flag."""
    booked = bookings_per_site_day(agendamento)
    lo = local.select("id_local", "capacidade")
    cap = C.null_as_zero("capacidade").cast("int")
    return booked.join(lo, "id_local", "left").select(
        "id_local", "data_agendamento", F.col("n_agendamentos").alias("booked"), cap.alias("capacity"),
        F.greatest(cap - F.col("n_agendamentos"), F.lit(0)).cast("bigint").alias("free"),
        (F.col("n_agendamentos") >= cap).alias("full"),
    )


def campaign_period_check(requests: DataFrame, campanha: DataFrame, day_col: str = "data_agendamento") -> DataFrame:
    """V5: the day lies in [data_inicio, data_fim] (NULL end = open)."""
    c = campanha.select("id_campanha", "data_inicio", "data_fim", F.lit(True).alias("_camp"))
    j = requests.join(c, "id_campanha", "left")
    reason = (F.when(F.col("_camp").isNull(), F.lit("invalid_campaign"))
              .when(~C.in_period(day_col, "data_inicio", "data_fim"), F.lit("out_of_period")))
    return j.select(*requests.columns, reason.isNull().alias("ok"), reason.alias("reason"))


DUP_KEYS = ("cpf", "id_vacina", "data_agendamento")


def duplicate_check(requests: DataFrame, agendamento: DataFrame) -> DataFrame:
    """V6: ok when no appointment has the same (cpf, lot, day)."""
    j = key_flag(requests, agendamento, DUP_KEYS, "_dup")
    return j.select(*requests.columns, (~F.col("_dup")).alias("ok"),
                    F.when(F.col("_dup"), F.lit("duplicate")).alias("reason"))


def duplicate_groups(agendamento: DataFrame, min_count: int = 2) -> DataFrame:
    """A2: (cpf, lot, day) groups with at least ``min_count`` appointments."""
    return agendamento.groupBy(*DUP_KEYS).agg(F.count(F.lit(1)).alias("n_agendamentos")) \
        .where(F.col("n_agendamentos") >= min_count)


def cidadao_exists(requests: DataFrame, cidadao: DataFrame, cpf_col: str = "cpf") -> DataFrame:
    """Flag ``exists`` per request cpf."""
    keys = cidadao.select(F.col("cpf").alias(cpf_col))
    return key_flag(requests, keys, [cpf_col], "exists", unique=True)


# -- J6: unreferenced rows (what a delete would accept) -------------------

def unreferenced(parent: DataFrame, key: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Rows of ``parent`` whose ``key`` no child column references.

    The referencing values of all children are unioned and made distinct
    (partial aggregation absorbs hot keys) before one anti join.
    """
    refs = None
    for child, col in children:
        r = child.select(F.col(col).alias(key))
        refs = r if refs is None else refs.unionByName(r)
    return parent.join(refs.distinct(), key, "left_anti")


def deletable_usuarios(usuario: DataFrame, vacinacao: DataFrame, agendamento: DataFrame,
                       parente: DataFrame) -> DataFrame:
    """Users a delete (C3) would accept: no dose, appointment or link."""
    return unreferenced(usuario, "cpf", (vacinacao, "cpf"), (agendamento, "cpf"),
                        (parente, "cpf_responsavel"), (parente, "cpf_parente"))
