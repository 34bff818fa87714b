"""Operators on the hand-written seed: expectations worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from imunis.functions import columns as C
from imunis.operators import filters as flt
from imunis.operators import integrity, lists, rules

from seed import tables

AS_OF = dt.date(2031, 4, 15)


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_role_counts(t):
    got = dict(rows(lists.role_counts(t), "tipo_usuario", "n_usuarios"))
    assert got == {"Cidadão": 4, "Administrador": 1, "Agente de Saúde": 0, "Usuário Genérico": 1}


def test_usuarios_completo_payloads(t):
    df = lists.usuarios_completo(t)
    r = {x["cpf"]: x for x in df.collect()}
    assert r["70000000003"]["tipo_usuario"] == "Cidadão"
    assert r["70000000003"]["admin_local_trabalho"] == "Clínica Ipê"
    assert r["70000000004"]["agente_email"] == "dora@exemplo.test"
    assert [x["nome"] for x in df.collect()][0] == "Aldo Nevoeiro"


def test_campanhas_ativas_order(t):
    got = [r["id_campanha"] for r in flt.campanhas_ativas(t["campanha"], AS_OF).collect()]
    assert got == [2, 1]


def test_vacinas_validas(t):
    assert rows(flt.vacinas_validas(t["vacina"], AS_OF), "id_vacina") == [(1,), (2,), (4,)]


def test_agendamentos_fan_out(t):
    df = lists.agendamentos(t)
    assert df.count() == 7
    assert df.where("id_agendamento = 4").select("id_campanha").collect()[0][0] is None
    first = df.collect()[0]
    assert first["data_agendamento"] == dt.date(2031, 3, 12)


def test_vacinacoes_and_parentescos(t):
    assert lists.vacinacoes(t).count() == 3
    par = lists.parentescos(t)
    assert rows(par, "id_parentesco") == [(1,), (2,), (3,)]


def test_filter_like_wildcards_and_blank(t):
    v = t["vacina"]
    assert rows(flt.filter_like(v, {"nome": "_x", "doenca_alvo": ""}), "id_vacina") == [(4,)]
    assert flt.filter_like(v, {"nome": None}).count() == 4
    assert rows(flt.filter_like(v, {"nome": "100%"}), "id_vacina") == [(4,)]


def test_filter_regex_null_and_case(t):
    df = lists.usuarios_completo(t, ordered=False)
    assert rows(flt.filter_regex(df, {"nome": "íris"}), "cpf") == [("70000000006",)]
    assert flt.filter_regex(df, {"cidade": "."}).count() == 3  # NULL city never matches
    assert flt.filter_regex(df, {"nome": "aldo"}, case_sensitive=["nome"]).count() == 0


def test_filter_any_and_range(t):
    par = lists.parentescos(t, ordered=False)
    assert flt.filter_any(par, [(["cpf_responsavel", "cpf_parente"], " 0003 ", True)]).count() == 1
    ag = lists.agendamentos(t, ordered=False)
    assert flt.filter_range(ag, "data_agendamento", "2031-03-12", "2031-03-12").count() == 1


def test_page_total_order(t):
    df = lists.vacinacoes(t, ordered=False)
    p0 = [r["id_vacinacao"] for r in flt.page(df, lists.VACINACOES_ORDER, 0, size=2).collect()]
    p1 = [r["id_vacinacao"] for r in flt.page(df, lists.VACINACOES_ORDER, 1, size=2).collect()]
    assert p0 == [2, 1] and p1 == [3]


def test_dates_text(spark):
    df = spark.createDataFrame([("31/02/2025",), ("15/04/2025",), ("2025-04-15",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(C.parse_date("s")).collect()]
    assert got == [None, dt.date(2025, 4, 15), dt.date(2025, 4, 15), None, None]
    f = spark.createDataFrame([(dt.date(2025, 1, 2),)], "d date").select(C.format_date("d")).collect()[0][0]
    assert f == "02/01/2025"


def test_strip_and_capitalize(spark):
    df = spark.createDataFrame([(" \t111\n", "são PAULO")], "a string, b string")
    r = df.select(C.strip_ws("a"), C.capitalize("b")).collect()[0]
    assert r[0] == "111" and r[1] == "São paulo"


def test_eligibility(t, spark):
    req = spark.createDataFrame(
        [(1, "70000000001", 3), (2, "70000000001", 1), (3, "70000000002", 1), (4, "70000000006", 2),
         (5, "70000000005", 2), (6, "70000000001", 99), (7, "70000000002", 2)],
        "req_seq long, cpf string, id_campanha int")
    got = {r["req_seq"]: (r["ok"], r["reason"]) for r in
           rules.eligibility(req, t["campanha"], t["cidadao"], t["usuario"]).collect()}
    assert got == {1: (True, None), 2: (False, "not_target"), 3: (True, None), 4: (False, "error_null_city"),
                   5: (False, "not_citizen"), 6: (False, "invalid_campaign"), 7: (True, None)}
    msg = rules.eligibility(req.where("req_seq = 2"), t["campanha"], t["cidadao"], t["usuario"]).collect()[0]
    assert msg["message"] == ("Cidadão de Pedra clara não se encaixa no público alvo da campanha "
                              "(idosos de aurora do vale).")


def test_stock_slots_period(t, spark):
    req = spark.createDataFrame([(1, 1), (2, 2), (3, 9)], "req_seq long, id_vacina int")
    got = {r["req_seq"]: r["reason"] for r in rules.stock_check(req, t["vacina"]).collect()}
    assert got == {1: None, 2: "no_stock", 3: "invalid_vaccine"}
    slots = {(r["id_local"], r["booked"], r["capacity"], r["free"], r["full"])
             for r in rules.slot_availability(t["agendamento"], t["local"]).collect()}
    assert slots == {(1, 3, 2, 0, True), (2, 1, 0, 0, True)}
    per = rules.campaign_period_check(t["vacinacao"].select("id_vacinacao", "id_campanha", "data_aplicacao"),
                                      t["campanha"], day_col="data_aplicacao")
    assert rows(per.where("ok"), "id_vacinacao") == [(1,), (2,)]


def test_duplicates_and_existence(t):
    assert rows(rules.duplicate_groups(t["agendamento"]), "cpf", "n_agendamentos") == [("70000000001", 2)]
    assert rows(rules.deletable_usuarios(t["usuario"], t["vacinacao"], t["agendamento"], t["parente"]), "cpf") == \
        [("70000000004",), ("70000000005",), ("70000000006",)]
    assert rules.unreferenced(t["vacina"], "id_vacina", (t["vacinacao"], "id_vacina")).count() == 2


def test_audits(t):
    fk = integrity.audit_fk(t)
    assert fk.count() == 0
    rng = {(r["table_name"], r["column_name"]): r["n_violations"] for r in integrity.audit_ranges(t).collect()}
    assert rng[("campanha", "tipo_vacina")] == 1 and rng[("vacina", "codigo_lote")] == 0
    cols = integrity.audit_columns(t).where("n_violations > 0").count()
    assert cols == 0
    dup = t["vacinacao"].unionByName(t["vacinacao"].where("id_vacinacao = 1"))
    pk = integrity.audit_pk({**t, "vacinacao": dup}).collect()
    assert [(r["table_name"], r["key_value"], r["n_rows"]) for r in pk] == [("vacinacao", "1", 2)]


def test_labels_last_wins(t, spark):
    v = t["vacina"].unionByName(spark.createDataFrame(
        [(9, "Influvac Teste", "Influenza B", "70415", dt.date(2031, 1, 1), dt.date(2032, 1, 1), 5)], t["vacina"].schema))
    got = dict(rows(lists.labels_agendamento_vacina({**t, "vacina": v}, AS_OF), "label", "id_vacina"))
    assert got["Influvac Teste (Lote: 70415)"] == 9
    got = dict(rows(lists.labels_vacina({**t, "vacina": v}, AS_OF), "label", "id_vacina"))
    assert got["Influvac Teste (Lote: 70415, Doses: 5)"] == 9 and len(got) == 3


def test_filter_like_backslash_rule(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",), ("a%b",)], "s string")

    def hits(text):
        return sorted(r[0] for r in flt.filter_like(df, {"s": text}).collect())

    assert hits("a\\b") == ["ab"]          # backslash before a letter stands for the letter
    assert hits("a\\%b") == ["a%b"]        # escaped % is a literal %
    assert hits("a\\") == []              # trailing backslash: a literal % that must end the text
    ends = spark.createDataFrame([("xa%",), ("a%x",), ("a",)], "s string")
    assert [r[0] for r in flt.filter_like(ends, {"s": "a\\"}).collect()] == ["xa%"]
    assert hits("a%b") == ["a%b", "a\\b", "ab"]  # typed % stays a wildcard


def test_regex_and_strip_know_unicode(spark):
    df = spark.createDataFrame([("José",), ("Jose",), ("J se",)], "s string")
    for cs in ([], ["s"]):
        got = sorted(r[0] for r in flt.filter_regex(df, {"s": r"^\w+$"}, case_sensitive=cs).collect())
        assert got == ["Jose", "José"]
    typed = spark.createDataFrame([("\u00a0\x1c111 2\u2003\n",), ("\u3000",)], "s string")
    assert [r[0] for r in typed.select(C.strip_ws("s")).collect()] == ["111 2", ""]


def test_page_after_equals_offset_paging(spark):
    rows_ = [(i, None if i % 4 == 0 else i % 3, None if i % 5 == 0 else "abc"[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows_, "id long, n int, s string")
    for keys in ([("n", "desc"), ("s", "asc"), ("id", "asc")], [("s", "desc"), ("n", "asc"), ("id", "desc")]):
        whole = [tuple(r) for r in flt.order(df, keys).collect()]
        for at in (0, 9, 10, 27, 38, 39):
            last = dict(zip(df.columns, whole[at]))
            got = [tuple(r) for r in flt.page_after(df, keys, last, 7).collect()]
            assert got == whole[at + 1:at + 8]
