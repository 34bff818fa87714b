"""Change-request batches derived from the driver tables.

Each batch is a pure function of the driver tables of one scale factor, so
it grows with them. The mix of values is chosen so that every check of the
operator fires on some rows (missing fields, bad dates, duplicates, unknown
keys, stock running out, ...). ``imunis.plans.oracle`` holds the same
derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import SPARE, UNKNOWN, Fixtures, cpf

ROLES_BY_MOD = ["Cidadão", "Administrador", "Agente de Saúde"]


def _k():
    return F.col("c_custkey")


def _idiv(col, n):
    return F.floor(col / F.lit(n)).cast("bigint")


def _role(idx):
    return (F.when(idx == 0, F.lit(ROLES_BY_MOD[0])).when(idx == 1, F.lit(ROLES_BY_MOD[1]))
            .otherwise(F.lit(ROLES_BY_MOD[2])))


def _user_payload(k):
    return [
        F.lpad(k.cast("string"), 15, "8").alias("cartao_sus"),
        F.concat(F.lit("Rua Nova "), (k % 30).cast("string")).alias("rua"),
        F.col("c_mktsegment").alias("bairro"),
        (k % 500).cast("int").alias("numero"),
        F.concat(F.lit("Cidade "), F.col("c_nationkey").cast("string")).alias("cidade"),
        F.lit("SP").alias("estado"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Posto "), (k % 100).cast("string"))).alias("local_trabalho"),
        F.concat(F.lit("novo"), k.cast("string"), F.lit("@x.br")).alias("email"),
        F.concat(F.lit("Posto "), (k % 100).cast("string")).alias("posto_trabalho"),
    ]


def usuario_insert_req(t: Fixtures) -> DataFrame:
    c = t.raw("customer").where((_k() % 5).isin(0, 1, 2))
    k = _k()
    return c.select(
        k.cast("bigint").alias("req_seq"),
        F.when(k % 5 == 0, F.concat(F.lit("  "), cpf(k)))
        .otherwise(F.concat(F.lit("9"), F.lpad(_idiv(k, 2).cast("string"), 10, "0"))).alias("cpf"),
        F.when(k % 13 == 0, F.lit("")).when(k % 29 == 0, F.repeat("c_name", 7)).otherwise(F.col("c_name")).alias("nome"),
        F.concat(F.lit("("), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(") 8"),
                 F.lpad(k.cast("string"), 8, "0")).alias("telefone"),
        _role(k % 3).alias("tipo_usuario"),
        *_user_payload(k),
    )


def usuario_update_req(t: Fixtures) -> DataFrame:
    k = _k()
    c = t.raw("customer").where((k % 4 == 1) | (k % 20 == 6))
    own = F.when(k % 43 == 0, F.concat(F.lit("8"), F.lpad(k.cast("string"), 10, "0"))).otherwise(cpf(k))
    return c.select(
        k.cast("bigint").alias("req_seq"),
        own.alias("cpf"),
        F.when(k % 37 == 0, F.lit(None).cast("string")).when(k % 16 == 5, cpf(k + 1))
        .otherwise(F.concat(F.lit(" "), own)).alias("cpf_digitado"),
        F.when(k % 41 == 0, F.repeat("c_name", 7)).otherwise(F.upper("c_name")).alias("nome"),
        F.when(k % 47 != 0, F.concat(F.lit("("), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(") 7"),
                                     F.lpad(k.cast("string"), 8, "0"))).alias("telefone"),
        _role(_idiv(k, 4) % 3).alias("tipo_usuario"),
        *_user_payload(k),
    )


def usuario_delete_req(t: Fixtures) -> DataFrame:
    c = t.raw("customer")
    k = _k()
    main = c.where(k % 6 == 0).select((k * 3).cast("bigint").alias("req_seq"), cpf(k).alias("cpf"))
    again = c.where(k % 12 == 0).select((k * 3 + 1).cast("bigint").alias("req_seq"), cpf(k).alias("cpf"))
    ghost = c.where(k % 18 == 0).select(
        (k * 3 + 2).cast("bigint").alias("req_seq"),
        F.concat(F.lit("9"), F.lpad(k.cast("string"), 10, "0")).alias("cpf"))
    return main.unionByName(again).unionByName(ghost)


def _day(base: str, n):
    return F.date_add(F.lit(base).cast("date"), n.cast("int"))


def _vacina_fields(p, name):
    pk = F.col("p_partkey")
    return [
        F.when(pk % 17 == 0, F.lit("")).when(pk % 29 == 0, F.repeat(name, 15)).otherwise(name).alias("nome"),
        F.col("p_type").alias("doenca_alvo"),
        F.when(pk % 19 == 0, F.lit("0")).when(pk % 23 == 0, F.col("p_brand"))
        .otherwise(F.regexp_replace("p_brand", "[^0-9]", "")).alias("codigo_lote"),
        _day("1996-01-01", pk % 300).alias("data_chegada"),
        _day("1996-01-01", pk % 300 + F.col("p_size") - 10).alias("data_validade"),
        F.when(pk % 31 != 0, F.col("p_size") - 5).cast("int").alias("qtd_doses"),
    ]


def vacina_insert_req(t: Fixtures) -> DataFrame:
    p = t.raw("part").where(F.col("p_partkey") % 4 == 0)
    return p.select(F.col("p_partkey").cast("bigint").alias("req_seq"), *_vacina_fields(p, F.col("p_name")))


def vacina_update_req(t: Fixtures) -> DataFrame:
    p = t.raw("part").where(F.col("p_partkey") % 4 == 1)
    return p.select(F.col("p_partkey").cast("bigint").alias("req_seq"),
                    ((F.col("p_partkey") * 7) % 1009 + F.when(F.col("p_partkey") % 13 == 0, UNKNOWN).otherwise(1))
                    .cast("bigint").alias("id_vacina"),
                    *_vacina_fields(p, F.upper("p_name")))


def vacina_delete_req(t: Fixtures) -> DataFrame:
    p, k = t.raw("part"), F.col("p_partkey")
    used = p.where(k % 3 == 0).select((k * 3).cast("bigint").alias("req_seq"), (k + 1).cast("bigint").alias("id_vacina"))
    spare = p.where(k % 20 == 7).select((k * 3 + 1).cast("bigint").alias("req_seq"), (k + SPARE).cast("bigint").alias("id_vacina"))
    ghost = p.where(k % 40 == 7).select((k * 3 + 2).cast("bigint").alias("req_seq"),
                                        (k + F.when(k % 80 == 7, SPARE).otherwise(UNKNOWN)).cast("bigint").alias("id_vacina"))
    return used.unionByName(spare).unionByName(ghost)


def _campanha_fields(prefix: str):
    k = _k()
    start = k % 365
    return [
        F.concat(F.lit(prefix), F.repeat("c_name", F.when(k % 13 == 0, 7).otherwise(1))).alias("nome"),
        F.col("c_mktsegment").alias("doenca_alvo"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).when(k % 2 == 0, F.lit("Dose Única"))
        .otherwise(F.lit("Múltiplas Doses")).alias("tipo_vacina"),
        _day("1996-01-01", start).alias("data_inicio"),
        F.when(k % 3 == 0, F.lit(None).cast("date"))
        .otherwise(_day("1996-01-01", start + (k % 7 - 2) * 30)).alias("data_fim"),
        F.when(k % 11 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("Moradores de NATION_"), F.col("c_nationkey").cast("string"))).alias("publico_alvo"),
    ]


def campanha_insert_req(t: Fixtures) -> DataFrame:
    c = t.raw("customer").where(_k() % 10 == 0)
    return c.select(_k().cast("bigint").alias("req_seq"), *_campanha_fields("Campanha "))


def campanha_update_req(t: Fixtures) -> DataFrame:
    c = t.raw("customer").where(_k() % 10 == 1)
    return c.select(_k().cast("bigint").alias("req_seq"), (_k() % 33 + 1).cast("int").alias("id_campanha"),
                    *_campanha_fields("Campanha Nova "))


def campanha_delete_req(t: Fixtures) -> DataFrame:
    c = t.raw("customer").where(_k() % 7 == 0)
    return c.select(_k().cast("bigint").alias("req_seq"), (_k() % 30 + 1).cast("int").alias("id_campanha"))


def _local_fields():
    s = F.col("s_suppkey")
    return [
        F.concat(F.lit("Posto "), F.repeat("s_name", F.when(s % 8 == 4, 6).otherwise(1))).alias("nome"),
        F.concat(F.lit("Rua "), (s % 50).cast("string")).alias("rua"),
        F.concat(F.lit("Bairro "), (s % 20).cast("string")).alias("bairro"),
        F.when(s % 7 == 0, F.lit(0)).otherwise(s + 1).cast("int").alias("numero"),
        F.concat(F.lit("Cidade "), F.col("s_nationkey").cast("string")).alias("cidade"),
        F.when(s % 11 == 0, F.lit("RJX")).otherwise(F.concat(F.lit("R"), (s % 5).cast("string"))).alias("estado"),
        F.concat(F.lit("(21) 9"), F.lpad(s.cast("string"), 8, "0")).alias("contato"),
        (s % 5 - 2).cast("int").alias("capacidade"),
    ]


def local_insert_req(t: Fixtures) -> DataFrame:
    s = t.raw("supplier").where(F.col("s_suppkey") % 3 == 0)
    return s.select(F.col("s_suppkey").cast("bigint").alias("req_seq"), *_local_fields())


def local_update_req(t: Fixtures) -> DataFrame:
    s = t.raw("supplier").where(F.col("s_suppkey") % 3 == 1)
    sk = F.col("s_suppkey")
    return s.select(sk.cast("bigint").alias("req_seq"),
                    F.when(sk % 9 == 4, sk + 2).when(sk % 9 == 7, sk + UNKNOWN).otherwise(sk + 1)
                    .cast("bigint").alias("id_local"), *_local_fields())


def local_delete_req(t: Fixtures) -> DataFrame:
    s, k = t.raw("supplier"), F.col("s_suppkey")
    used = s.where(k % 2 == 0).select((k * 3).cast("bigint").alias("req_seq"), (k + 1).cast("bigint").alias("id_local"))
    spare = s.where(k % 10 == 3).select((k * 3 + 1).cast("bigint").alias("req_seq"), (k + SPARE).cast("bigint").alias("id_local"))
    ghost = s.where(k % 10 == 1).select((k * 3 + 2).cast("bigint").alias("req_seq"), (k + UNKNOWN).cast("bigint").alias("id_local"))
    return used.unionByName(spare).unionByName(ghost)


def parente_insert_req(t: Fixtures) -> DataFrame:
    c = t.raw("customer").where(_k() % 10 <= 7)
    k = _k()
    par = (F.when(k % 19 == 0, F.lit("")).when(k % 23 == 0, F.repeat(cpf(k), 2)).when(k % 3 == 0, cpf(k + 2)).when(k % 3 == 1, cpf(k))
           .otherwise(cpf(k + 1)))
    main = c.select((k * 2).cast("bigint").alias("req_seq"), cpf(k).alias("cpf_responsavel"), par.alias("cpf_parente"))
    again = c.where(k % 9 == 0).select((k * 2 + 1).cast("bigint").alias("req_seq"), cpf(k).alias("cpf_responsavel"),
                                       par.alias("cpf_parente"))
    return main.unionByName(again)


def parente_update_req(t: Fixtures) -> DataFrame:
    c = t.raw("customer").where(_k() % 2 == 0)
    k = _k()
    return c.select(k.cast("bigint").alias("req_seq"), k.cast("bigint").alias("id_parentesco"),
                    cpf(k).alias("cpf_responsavel"),
                    F.when(k % 7 == 0, cpf(k)).when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.repeat(cpf(k), 2))
                    .otherwise(cpf(k + 3)).alias("cpf_parente"))


def parente_delete_req(t: Fixtures) -> DataFrame:
    c = t.raw("customer")
    k = _k()
    main = c.where(k % 4 == 0).select((k * 2).cast("bigint").alias("req_seq"), k.cast("bigint").alias("id_parentesco"))
    again = c.where(k % 8 == 0).select((k * 2 + 1).cast("bigint").alias("req_seq"),
                                       k.cast("bigint").alias("id_parentesco"))
    return main.unionByName(again)


def _typed_cpf():
    """The order's cpf as typed: sometimes empty, blank, or too long."""
    k, own = F.col("l_orderkey"), cpf("o_custkey")
    return (F.when(k % 47 == 0, F.lit("")).when(k % 41 == 0, F.lit("   ")).when(k % 53 == 0, F.repeat(own, 2))
            .when(k % 3 == 0, F.concat(F.lit(" "), own)).otherwise(own))


def agendamento_insert_req(t: Fixtures) -> DataFrame:
    d = t["dose_line"].where(F.col("l_linenumber") == 2)
    return d.select(
        F.col("l_orderkey").cast("bigint").alias("req_seq"), _typed_cpf().alias("cpf"),
        (F.col("l_orderkey") % 27 + 1).cast("int").alias("id_campanha"),
        (F.col("l_partkey") + 1).cast("bigint").alias("id_vacina"), (F.col("l_suppkey") + 1).cast("bigint").alias("id_local"),
        F.col("o_orderdate").cast("date").alias("data_agendamento"))


def agendamento_update_req(t: Fixtures) -> DataFrame:
    d = t["dose_line"].where(F.col("l_linenumber") == 3)
    return d.select(
        F.col("l_orderkey").cast("bigint").alias("req_seq"), F.col("l_orderkey").cast("bigint").alias("id_agendamento"),
        _typed_cpf().alias("cpf"), (F.col("l_orderkey") % 27 + 1).cast("int").alias("id_campanha"),
        (F.col("l_partkey") + 1).cast("bigint").alias("id_vacina"), (F.col("l_suppkey") + 1).cast("bigint").alias("id_local"),
        F.date_add(F.col("o_orderdate").cast("date"), 7).alias("data_agendamento"))


def agendamento_delete_req(t: Fixtures) -> DataFrame:
    d = t["dose_line"].where((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 3 == 0))
    return d.select(F.col("l_orderkey").cast("bigint").alias("req_seq"),
                    F.col("l_orderkey").cast("bigint").alias("id_agendamento"))


def vacinacao_update_req(t: Fixtures) -> DataFrame:
    d = t["dose_line"].where((F.col("l_linenumber") <= 4) & (F.col("l_orderkey") % 5 == 0))
    vac, k = F.col("l_partkey") + 1, F.col("l_orderkey")
    seq = k * 8 + F.col("l_linenumber")
    return d.select(
        seq.cast("bigint").alias("req_seq"),
        (seq + F.when(k % 55 == 0, UNKNOWN).otherwise(0)).cast("bigint").alias("id_vacinacao"),
        F.when(k % 35 == 0, 0).otherwise(F.col("l_linenumber")).cast("int").alias("contagem"),
        F.when(k % 65 != 0, F.col("l_shipdate").cast("date")).alias("data_aplicacao"),
        F.when(k % 85 == 0, vac + UNKNOWN).when(k % 2 == 0, vac).otherwise((vac * 7) % 50 + 1).cast("bigint").alias("id_vacina"),
        F.when(k % 45 == 0, F.lit(" ")).otherwise(cpf("o_custkey")).alias("cpf"),
        (F.col("l_suppkey") + 1).cast("bigint").alias("id_local"),
        (F.col("l_orderkey") % 27 + 1).cast("int").alias("id_campanha"))


def vacinacao_delete_req(t: Fixtures) -> DataFrame:
    d = t["dose_line"].where((F.col("l_linenumber") <= 4) & (F.col("l_orderkey") % 3 == 0))
    vid = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    main = d.select((vid * 2).cast("bigint").alias("req_seq"), vid.cast("bigint").alias("id_vacinacao"))
    again = d.where(F.col("l_orderkey") % 6 == 0).select((vid * 2 + 1).cast("bigint").alias("req_seq"),
                                                         vid.cast("bigint").alias("id_vacinacao"))
    return main.unionByName(again)


# ---- batches whose requests depend on one another

def vacinacao_chain_req(t: Fixtures) -> DataFrame:
    """Two lot changes of each dose, mixed with those of the other doses."""
    d = t["dose_line"].where((F.col("l_linenumber") <= 4) & (F.col("l_orderkey") % 13 == 0))
    k, n = F.col("l_orderkey"), F.col("step")
    dose = k * 8 + F.col("l_linenumber")
    d = d.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    return d.select(
        ((F.col("l_partkey") % 11 * 2 + n) * F.lit(10 ** 10) + dose).cast("bigint").alias("req_seq"), dose.cast("bigint").alias("id_vacinacao"),
        F.col("l_linenumber").cast("int").alias("contagem"), F.col("l_shipdate").cast("date").alias("data_aplicacao"),
        F.when((k + n) % 31 == 0, F.col("l_partkey") + UNKNOWN).otherwise((F.col("l_partkey") * (n + 2)) % 97 + 2).cast("bigint").alias("id_vacina"),
        cpf("o_custkey").alias("cpf"), (F.col("l_suppkey") + F.when((k + n) % 13 == 0, UNKNOWN).otherwise(1)).cast("bigint").alias("id_local"),
        (k % 27 + 1).cast("int").alias("id_campanha"))


def vacinacao_mixed_req(t: Fixtures) -> DataFrame:
    """Three requests around each dose, inserts, updates and deletes in turn, mixed with those of the other doses."""
    d = t["dose_line"].where((F.col("l_linenumber") <= 4) & (F.col("l_orderkey") % 13 == 1))
    d = d.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step"))
    k, n = F.col("l_orderkey"), F.col("step")
    dose, turn = k * 8 + F.col("l_linenumber"), (k + F.col("l_linenumber") + n) % 3
    return d.select(
        ((F.col("l_partkey") % 11 * 3 + n) * F.lit(10 ** 10) + dose).cast("bigint").alias("req_seq"),
        F.when((k + n) % 41 == 0, "merge").when(turn == 0, "insert").when(turn == 1, "update").otherwise("delete").alias("kind"),
        F.when(turn != 0, dose + F.when(k % 55 == 1, UNKNOWN).otherwise(0)).cast("bigint").alias("id_vacinacao"),
        F.when(k % 35 == 0, 0).otherwise(F.col("l_linenumber")).cast("int").alias("contagem"),
        F.when(k % 65 != 1, F.col("l_shipdate").cast("date")).alias("data_aplicacao"),
        F.when((k + n) % 31 == 0, F.col("l_partkey") + UNKNOWN).otherwise((F.col("l_partkey") * (n + 2)) % 97 + 2).cast("bigint").alias("id_vacina"),
        F.when(k % 45 == 0, F.lit(" ")).when(k % 37 == 0, F.lit("nobody")).otherwise(cpf("o_custkey")).alias("cpf"),
        (F.col("l_suppkey") + F.when((k + n) % 13 == 2, UNKNOWN).otherwise(1)).cast("bigint").alias("id_local"),
        (k % 27 + 1).cast("int").alias("id_campanha"))


def agendamento_chain_req(t: Fixtures) -> DataFrame:
    """The same appointment asked for at several sites, on few days."""
    d = t["dose_line"].where((F.col("l_linenumber") <= 2))
    k, n = F.col("l_orderkey"), F.col("step")
    d = d.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step"))
    return d.select(
        (k * 8 + F.col("l_linenumber") * 3 + n - 3).cast("bigint").alias("req_seq"), cpf("o_custkey").alias("cpf"),
        (k % 27 + 1).cast("int").alias("id_campanha"), (F.col("l_partkey") % 5 + 1).cast("bigint").alias("id_vacina"),
        ((F.col("l_suppkey") * 3 + n) % 4 + 2).cast("bigint").alias("id_local"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("o_custkey") % 97).cast("int")).alias("data_agendamento"))


def usuario_chain_req(t: Fixtures) -> DataFrame:
    """Four updates of each user, mostly to another role."""
    k, n = _k(), F.col("step")
    c = t.raw("customer").where(k % 3 != 0).select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("step"))
    return c.select(
        (n * F.lit(10 ** 10) + k).cast("bigint").alias("req_seq"), cpf(k).alias("cpf"),
        F.when((k + n) % 29 == 0, F.lit("x")).otherwise(cpf(k)).alias("cpf_digitado"),
        F.concat(F.col("c_name"), F.lit(" "), n.cast("string")).alias("nome"),
        F.when((k + n) % 17 != 0, F.lpad(k.cast("string"), 9, "0")).alias("telefone"),
        _role((_idiv(k, 3) + n * (k % 3)) % 3).alias("tipo_usuario"),
        *_user_payload(k + n))
