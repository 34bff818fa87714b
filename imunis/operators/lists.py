"""The joined lists of the programme (J1–J5), labels (P5, P6) and displays.

Input is a mapping ``name -> DataFrame`` with the ten tables. Every list
returns a lazy DataFrame; ``ordered=False`` drops the final global sort when
the caller filters, pages or aggregates further.

Join strategy: facts join their dimensions on high-cardinality keys; Spark
broadcasts a dimension only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run time), else it
shuffles. The one low-cardinality key — the disease that links a lot to its
campaigns in J1 — is salted so no single task receives all rows of one
disease.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import filters as flt

Tables = Mapping[str, DataFrame]

SALT_BUCKETS = 64


def _order(df: DataFrame, keys, ordered: bool) -> DataFrame:
    return flt.order(df, keys) if ordered else df


# -- J1 -----------------------------------------------------------------

def booked_lots(vacina: DataFrame, agendamento: DataFrame, campanha: DataFrame,
                salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Lots that some appointment books, with every campaign of their disease:
    (id_vacina, nome_vacina, id_campanha, nome_campanha).

    ``doenca_alvo`` has a handful of values, so a shuffle join on it alone
    would put a whole disease in one task. Each lot gets a salt from its id
    and each campaign row is repeated once per salt, so the join key
    (disease, salt) has ``salt_buckets`` times more values. When the campaign
    side is small Spark broadcasts it and the salt costs nothing.
    """
    booked = agendamento.select("id_vacina").distinct()
    v = vacina.join(booked, "id_vacina", "left_semi").select(
        "id_vacina", F.col("nome").alias("nome_vacina"), "doenca_alvo",
        F.pmod(F.xxhash64("id_vacina"), F.lit(salt_buckets)).cast("int").alias("_salt"))
    c = campanha.select("doenca_alvo", "id_campanha", F.col("nome").alias("nome_campanha")) \
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return v.join(c, ["doenca_alvo", "_salt"], "left").select("id_vacina", "nome_vacina", "id_campanha", "nome_campanha")


def agendamentos(t: Tables, ordered: bool = True, salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Appointments with citizen, lot, site and every campaign of the lot's
    disease (left joins; several campaigns -> several rows). Everything about
    a lot is put together first, so the appointments join by lot once."""
    a = t["agendamento"]
    u = t["usuario"].select("cpf", F.col("nome").alias("nome_cidadao"))
    lots = booked_lots(t["vacina"], a, t["campanha"], salt_buckets)
    lo = t["local"].select("id_local", F.col("nome").alias("nome_local"))
    out = (
        a.join(u, "cpf", "left")
        .join(lo, "id_local", "left")
        .join(lots, "id_vacina", "left")
        .select("id_agendamento", "cpf", "nome_cidadao", "id_vacina", "nome_vacina",
                "id_campanha", "nome_campanha", "id_local", "nome_local", "data_agendamento")
    )
    return _order(out, [("data_agendamento", "desc"), ("nome_cidadao", "asc"),
                        ("id_agendamento", "asc"), ("id_campanha", "asc")], ordered)


def agendamentos_display(t: Tables, ordered: bool = True) -> DataFrame:
    """P13 + P3: keep the DATE as ``data_agendamento_original``, show text."""
    df = agendamentos(t, ordered=False)
    out = df.withColumn("data_agendamento_original", F.col("data_agendamento")) \
        .withColumn("data_agendamento", C.format_date("data_agendamento"))
    return _order(out, [("data_agendamento_original", "desc"), ("nome_cidadao", "asc"),
                        ("id_agendamento", "asc"), ("id_campanha", "asc")], ordered)


# -- J2, J3 ---------------------------------------------------------------

def usuarios_completo(t: Tables, ordered: bool = True) -> DataFrame:
    """J2 + P2: every user with the role shown and the three role payloads."""
    u = t["usuario"]
    c = t["cidadao"].select(F.col("cpf").alias("_c_cpf"), "cartao_sus", "rua", "bairro", "numero", "cidade", "estado")
    a = t["administrador"].select(F.col("cpf").alias("_a_cpf"), F.col("local_trabalho").alias("admin_local_trabalho"))
    s = t["agente_saude"].select(F.col("cpf").alias("_s_cpf"), F.col("email").alias("agente_email"),
                                 F.col("posto_trabalho").alias("agente_posto_trabalho"))
    out = (
        u.join(c, u.cpf == c._c_cpf, "left")
        .join(a, u.cpf == a._a_cpf, "left")
        .join(s, u.cpf == s._s_cpf, "left")
        .select("cpf", "nome", "telefone", C.role("_c_cpf", "_a_cpf", "_s_cpf").alias("tipo_usuario"),
                "cartao_sus", "rua", "bairro", "numero", "cidade", "estado",
                "admin_local_trabalho", "agente_email", "agente_posto_trabalho")
    )
    return _order(out, [("nome", "asc"), ("cpf", "asc")], ordered)


def role_counts(t: Tables) -> DataFrame:
    """Users per shown role (P2), all four roles present even when zero."""
    roles = usuarios_completo(t, ordered=False).groupBy("tipo_usuario").agg(F.count(F.lit(1)).alias("n_usuarios"))
    spark = t["usuario"].sparkSession
    from ..sources.schemas import ROLE_ADMIN, ROLE_AGENTE, ROLE_CIDADAO, ROLE_GENERICO
    allr = spark.createDataFrame([(r,) for r in (ROLE_CIDADAO, ROLE_ADMIN, ROLE_AGENTE, ROLE_GENERICO)],
                                 "tipo_usuario string")
    return allr.join(roles, "tipo_usuario", "left").select(
        "tipo_usuario", F.coalesce("n_usuarios", F.lit(0)).cast("bigint").alias("n_usuarios"))


def cidadaos(t: Tables, ordered: bool = True) -> DataFrame:
    """Citizens with their user name."""
    out = t["cidadao"].join(t["usuario"].select("cpf", "nome"), "cpf").select(
        "cpf", "nome", "cartao_sus", "rua", "bairro", "numero", "cidade", "estado")
    return _order(out, [("nome", "asc"), ("cpf", "asc")], ordered)


# -- J4 -------------------------------------------------------------------

def vacinacoes(t: Tables, ordered: bool = True) -> DataFrame:
    """Doses with citizen, lot, site and campaign names (inner joins)."""
    d = t["vacinacao"]
    u = t["usuario"].select("cpf", F.col("nome").alias("nome_cidadao"))
    v = t["vacina"].select("id_vacina", F.col("nome").alias("nome_vacina"))
    lo = t["local"].select("id_local", F.col("nome").alias("nome_local"))
    c = t["campanha"].select("id_campanha", F.col("nome").alias("nome_campanha"))
    out = (
        d.join(u, "cpf").join(v, "id_vacina").join(lo, "id_local").join(c, "id_campanha")
        .select("id_vacinacao", "contagem", "data_aplicacao", "nome_cidadao", "nome_vacina",
                "nome_local", "nome_campanha", "cpf", "id_vacina", "id_local", "id_campanha")
    )
    return _order(out, VACINACOES_ORDER, ordered)


VACINACOES_ORDER = [("data_aplicacao", "desc"), ("nome_cidadao", "asc"), ("nome_vacina", "asc"),
                    ("id_vacinacao", "asc")]


# -- J5 -------------------------------------------------------------------

def parentescos(t: Tables, ordered: bool = True) -> DataFrame:
    """Links whose both ends are citizens, with both names."""
    cit = t["cidadao"].select("cpf").join(t["usuario"].select("cpf", "nome"), "cpf")
    r = cit.select(F.col("cpf").alias("_r_cpf"), F.col("nome").alias("nome_responsavel"))
    p = cit.select(F.col("cpf").alias("_p_cpf"), F.col("nome").alias("nome_parente"))
    pr = t["parente"]
    out = (
        pr.join(r, pr.cpf_responsavel == r._r_cpf)
        .join(p, pr.cpf_parente == p._p_cpf)
        .select("id_parentesco", "cpf_responsavel", "nome_responsavel", "cpf_parente", "nome_parente")
    )
    return _order(out, [("nome_responsavel", "asc"), ("nome_parente", "asc"), ("id_parentesco", "asc")], ordered)


# -- S1 / S1b scans -------------------------------------------------------

def scan_vacinas(t: Tables, ordered: bool = True) -> DataFrame:
    return _order(t["vacina"], [("id_vacina", "desc")], ordered)


def scan_campanhas(t: Tables, ordered: bool = True) -> DataFrame:
    return _order(t["campanha"], [("id_campanha", "desc")], ordered)


def scan_locais(t: Tables, ordered: bool = True) -> DataFrame:
    return _order(t["local"], [("nome", "asc"), ("id_local", "asc")], ordered)


def locais(t: Tables, ordered: bool = True) -> DataFrame:
    """The nine site columns used by the forms, by name."""
    out = t["local"].select("id_local", "nome", "rua", "bairro", "numero", "cidade", "estado", "contato", "capacidade")
    return _order(out, [("nome", "asc"), ("id_local", "asc")], ordered)


# -- P5 / P6 labels -------------------------------------------------------

def labels_vacina(t: Tables, as_of=None) -> DataFrame:
    """P5 + P6 (dose form): 'nome (Lote: x, Doses: n)' -> id over unexpired lots;
    of equal labels the later one in list order (by name, then id) wins."""
    v = flt.vacinas_validas(t["vacina"], as_of, ordered=False)
    return _last_label(v, C.label_vacina_stock("nome", "codigo_lote", "qtd_doses"), "id_vacina")


def labels_local(t: Tables) -> DataFrame:
    """P5 + P6: 'nome (cidade)' -> id, the later site of the list wins."""
    return _last_label(t["local"], C.label_local("nome", "cidade"), "id_local")


def _last_label(df: DataFrame, label, key: str) -> DataFrame:
    """(label, key): of equal labels the last row in the list's order (nome, key).

    An arg-max per label, not a window: partial aggregation keeps a popular
    label from gathering all of its rows in one task.
    """
    last = F.max(F.struct("nome", key)).getField(key)
    return df.groupBy(label.alias("label")).agg(last.alias(key))


def labels_campanha(t: Tables, as_of=None) -> DataFrame:
    """P5 (dose form): 'nome (ID: n)' over active campaigns."""
    c = flt.campanhas_ativas(t["campanha"], as_of, ordered=False)
    return c.select(C.label_campanha_id("nome", "id_campanha").alias("label"), "id_campanha")


def labels_cidadao(t: Tables) -> DataFrame:
    c = cidadaos(t, ordered=False)
    return c.select(C.label_cidadao("nome", "cpf").alias("label"), "cpf")


def labels_agendamento_vacina(t: Tables, as_of=None) -> DataFrame:
    """Appointment-form lot labels 'nome (Lote: x)'. The form builds a dict
    from the list ordered by name, so of equal labels the later one wins; rows
    tied in list order keep the highest id."""
    v = flt.vacinas_validas(t["vacina"], as_of, ordered=False)
    return _last_label(v, C.label_vacina("nome", "codigo_lote"), "id_vacina")


def labels_agendamento_campanha(t: Tables, as_of=None) -> DataFrame:
    """P6 for the appointment form's campaign names: the list is by start
    descending, so of equal names the earliest start wins (then highest id)."""
    c = flt.campanhas_ativas(t["campanha"], as_of, ordered=False)
    win = F.min(F.struct(F.col("data_inicio"), (-F.col("id_campanha")).alias("neg_id"))).getField("neg_id")
    return c.groupBy(F.col("nome").alias("label")).agg((-win).cast("int").alias("id_campanha"))


# -- P3 / P4 --------------------------------------------------------------

def format_dates(df: DataFrame, cols) -> DataFrame:
    """P3 over the named DATE columns."""
    for c in cols:
        df = df.withColumn(c, C.format_date(c))
    return df


def parse_dates(df: DataFrame, cols) -> DataFrame:
    """P4 over the named text columns."""
    for c in cols:
        df = df.withColumn(c, C.parse_date(c))
    return df
