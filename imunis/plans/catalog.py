"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` plus their SQL oracle.

Each query binds the driver tables of ``sf_dir`` to the programme tables and
runs one operator of SURVEY §2 over the whole tables. The SQL next to it is an
independent DuckDB formulation used by the correctness check.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators import lists, paging
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

AS_OF = fx.AS_OF
AS_OF_SQL = "DATE '1998-06-01'"


def query(name: str, sql: str | tuple[dict[str, str], str] | None = None):
    def deco(fn: Callable[[fx.Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fx.load(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- S1, S1b

@query("scan_vacinas", "SELECT * FROM vacina ORDER BY id_vacina DESC")
def scan_vacinas(t):
    """Full scan of vacina, newest id first."""
    return lists.scan_vacinas(t)


@query("scan_campanhas", "SELECT * FROM campanha ORDER BY id_campanha DESC")
def scan_campanhas(t):
    return lists.scan_campanhas(t)


@query("scan_locais", "SELECT * FROM local ORDER BY nome, id_local")
def scan_locais(t):
    return lists.scan_locais(t)


@query("locais", """
    SELECT id_local, nome, rua, bairro, numero, cidade, estado, contato, capacidade
    FROM local ORDER BY nome, id_local""")
def locais(t):
    return lists.locais(t)


# ---------------------------------------------------------------- J1–J5

# Every lot with each campaign of its disease (or none); appointments look their lot up in it.
_BOOKINGS = """
    (SELECT booking.*, person.nome AS nome_cidadao, offer.lot AS nome_vacina, offer.id_campanha, offer.programme
            AS nome_campanha, (SELECT any_value(nome) FROM local WHERE local.id_local = booking.id_local) AS nome_local
     FROM (SELECT vacina.id_vacina, vacina.nome AS lot, campanha.id_campanha, campanha.nome AS programme
           FROM campanha RIGHT JOIN vacina USING (doenca_alvo)) offer
     RIGHT JOIN agendamento booking USING (id_vacina)
     LEFT JOIN usuario person USING (cpf))"""


@query("agendamentos", f"""
    SELECT id_agendamento, cpf, nome_cidadao, id_vacina, nome_vacina, id_campanha, nome_campanha, id_local, nome_local,
           data_agendamento
    FROM {_BOOKINGS} z""")
def agendamentos(t):
    """Appointments with the campaigns of the lot's disease (fan-out kept)."""
    return lists.agendamentos(t)


@query("agendamentos_display", f"""
    SELECT id_agendamento, cpf, nome_cidadao, id_vacina, nome_vacina, id_campanha, nome_campanha, id_local, nome_local,
           strftime(data_agendamento, '%d/%m/%Y') AS data_agendamento, data_agendamento AS data_agendamento_original
    FROM {_BOOKINGS} z""")
def agendamentos_display(t):
    """P13 + P3 on J1."""
    return lists.agendamentos_display(t)


def role_sql(who: str, citizens: str = "cidadao", admins: str = "administrador", agents: str = "agente_saude") -> str:
    """The role shown (P2), by membership in the three key sets."""
    return (f"CASE WHEN {who} IN (SELECT cpf FROM {citizens}) THEN 'Cidadão' "
            f"WHEN {who} IN (SELECT cpf FROM {admins}) THEN 'Administrador' "
            f"WHEN {who} IN (SELECT cpf FROM {agents}) THEN 'Agente de Saúde' ELSE 'Usuário Genérico' END")


def user_list_sql(users: str = "usuario", citizens: str = "cidadao", admins: str = "administrador",
                  agents: str = "agente_saude") -> str:
    """J2 over the named tables: payloads side by side, the role from the key sets."""
    return f"""
    SELECT cpf, people.nome, people.telefone, {role_sql('cpf', citizens, admins, agents)} AS tipo_usuario,
           home.cartao_sus, home.rua, home.bairro, home.numero, home.cidade, home.estado,
           office.admin_local_trabalho, post.agente_email, post.agente_posto_trabalho
    FROM {users} people
    LEFT JOIN (SELECT cpf, email AS agente_email, posto_trabalho AS agente_posto_trabalho FROM {agents}) post USING (cpf)
    LEFT JOIN (SELECT cpf, local_trabalho AS admin_local_trabalho FROM {admins}) office USING (cpf)
    LEFT JOIN {citizens} home USING (cpf)"""


def role_counts_sql(users: str = "usuario", citizens: str = "cidadao", admins: str = "administrador",
                    agents: str = "agente_saude") -> str:
    return f"""
    SELECT tipo_usuario, cast(sum(n) AS bigint) AS n_usuarios
    FROM (SELECT {role_sql('cpf', citizens, admins, agents)} AS tipo_usuario, 1 AS n FROM {users}
          UNION ALL VALUES ('Cidadão', 0), ('Administrador', 0), ('Agente de Saúde', 0), ('Usuário Genérico', 0)) z
    GROUP BY tipo_usuario"""


@query("usuarios_completo", user_list_sql())
def usuarios_completo(t):
    """J2 + P2."""
    return lists.usuarios_completo(t)


@query("role_counts", role_counts_sql())
def role_counts(t):
    return lists.role_counts(t)


@query("cidadaos", """
    SELECT cpf, nome, cartao_sus, rua, bairro, numero, cidade, estado FROM usuario NATURAL JOIN cidadao""")
def cidadaos(t):
    """J3."""
    return lists.cidadaos(t)


# Names looked up dose by dose; a dose with a key that no table has is not listed.
VACINACOES_SQL = """
    SELECT * FROM (
      SELECT cpf, id_campanha, id_local, id_vacina, id_vacinacao, data_aplicacao, contagem,
             (SELECT nome FROM campanha k WHERE k.id_campanha = dose.id_campanha) AS nome_campanha,
             (SELECT nome FROM local s WHERE s.id_local = dose.id_local) AS nome_local,
             (SELECT nome FROM vacina w WHERE w.id_vacina = dose.id_vacina) AS nome_vacina,
             (SELECT nome FROM usuario p WHERE p.cpf = dose.cpf) AS nome_cidadao
      FROM vacinacao dose
      WHERE cpf IN (SELECT cpf FROM usuario) AND id_vacina IN (SELECT id_vacina FROM vacina)
        AND id_local IN (SELECT id_local FROM local) AND id_campanha IN (SELECT id_campanha FROM campanha)) named"""


@query("vacinacoes", VACINACOES_SQL)
def vacinacoes(t):
    """The dose list."""
    return lists.vacinacoes(t)


# Names of citizens; each end of a link looks itself up.
_CITIZEN_NAMES = "(SELECT cpf, nome FROM usuario WHERE cpf IN (SELECT cpf FROM cidadao))"


@query("parentescos", f"""
    SELECT id_parentesco, cpf_responsavel, guardian.nome AS nome_responsavel, cpf_parente, kin.nome AS nome_parente
    FROM {_CITIZEN_NAMES} kin, {_CITIZEN_NAMES} guardian, parente
    WHERE kin.cpf = cpf_parente AND guardian.cpf = cpf_responsavel""")
def parentescos(t):
    """J5."""
    return lists.parentescos(t)


# ---------------------------------------------------------------- F1–F7, O3, A3

@query("filter_vacinas", """
    SELECT * FROM vacina WHERE nome ILIKE '%RING%' AND doenca_alvo ILIKE '%a%'""")
def filter_vacinas(t):
    """ILIKE on name and disease."""
    return flt.order(flt.filter_like(t["vacina"], {"nome": "RING", "doenca_alvo": "a"}), [("id_vacina", "desc")])


@query("filter_campanhas", """
    SELECT * FROM campanha
    WHERE nome ILIKE '%nation_1%' AND publico_alvo ILIKE '%moradores%'""")
def filter_campanhas(t):
    """F1 with a blank filter dropped (doenca_alvo) and a live ``_`` wildcard."""
    f = {"nome": "nation_1", "doenca_alvo": "", "publico_alvo": "moradores"}
    return flt.order(flt.filter_like(t["campanha"], f), [("id_campanha", "desc")])


@query("filter_locais", """
    SELECT * FROM local
    WHERE nome ILIKE '%supplier#00000001%' AND cidade ILIKE '%nation%' AND bairro ILIKE '%bairro 1%'""")
def filter_locais(t):
    f = {"nome": "supplier#00000001", "cidade": "nation", "bairro": "bairro 1"}
    return flt.order(flt.filter_like(t["local"], f), [("nome", "asc"), ("id_local", "asc")])


@query("filter_usuarios", """
    SELECT * FROM (""" + ORACLE["usuarios_completo"] + """) x
    WHERE coalesce(regexp_matches(cpf, '0+1', 'i'), false)
      AND coalesce(regexp_matches(nome, 'customer#0+1[0-9]?$', 'i'), false)""")
def filter_usuarios(t):
    """regex on cpf and name, both case-insensitive."""
    df = lists.usuarios_completo(t, ordered=False)
    out = flt.filter_regex(df, {"cpf": "0+1", "nome": "customer#0+1[0-9]?$"})
    return flt.order(out, [("nome", "asc"), ("cpf", "asc")])


@query("filter_agendamentos", """
    SELECT * FROM (""" + ORACLE["agendamentos"] + """) x
    WHERE coalesce(regexp_matches(cpf, '00[0-4]$'), false)
      AND coalesce(regexp_matches(nome_cidadao, 'CUSTOMER', 'i'), false)
      AND data_agendamento >= DATE '1996-01-01' AND data_agendamento <= DATE '1999-12-31'""")
def filter_agendamentos(t):
    """F3 (cpf case-sensitive, name not) + F5 inclusive date range."""
    df = lists.agendamentos(t, ordered=False)
    df = flt.filter_regex(df, {"cpf": "00[0-4]$", "nome_cidadao": "CUSTOMER"}, case_sensitive=["cpf"])
    df = flt.filter_range(df, "data_agendamento", "1996-01-01", "1999-12-31")
    return flt.order(df, [("data_agendamento", "desc"), ("nome_cidadao", "asc"),
                          ("id_agendamento", "asc"), ("id_campanha", "asc")])


@query("filter_vacinacoes", """
    SELECT * FROM (""" + VACINACOES_SQL + """) x
    WHERE coalesce(regexp_matches(nome_vacina, 'R.NG', 'i'), false)
      AND coalesce(regexp_matches(nome_cidadao, '#0000001', 'i'), false)
      AND data_aplicacao >= DATE '1996-06-01'""")
def filter_vacinacoes(t):
    """F3 + F5 on the dose list (only a lower date bound)."""
    df = lists.vacinacoes(t, ordered=False)
    df = flt.filter_regex(df, {"nome_vacina": "R.NG", "nome_cidadao": "#0000001"})
    df = flt.filter_range(df, "data_aplicacao", "1996-06-01", None)
    return flt.order(df, lists.VACINACOES_ORDER)


@query("filter_parentescos", """
    SELECT * FROM (""" + ORACLE["parentescos"] + """) x
    WHERE (coalesce(regexp_matches(cpf_responsavel, '0000012'), false)
           OR coalesce(regexp_matches(cpf_parente, '0000012'), false))
      AND (coalesce(regexp_matches(nome_responsavel, 'customer', 'i'), false)
           OR coalesce(regexp_matches(nome_parente, 'customer', 'i'), false))""")
def filter_parentescos(t):
    """one text against either end of the link; the text is stripped."""
    df = lists.parentescos(t, ordered=False)
    out = flt.filter_any(df, [(["cpf_responsavel", "cpf_parente"], " 0000012 ", True),
                              (["nome_responsavel", "nome_parente"], "customer", False)])
    return flt.order(out, [("nome_responsavel", "asc"), ("nome_parente", "asc"), ("id_parentesco", "asc")])


@query("filter_result_count", """
    SELECT cast(count(*) AS bigint) AS n_rows FROM (""" + VACINACOES_SQL + """) x
    WHERE coalesce(regexp_matches(nome_vacina, 'ring', 'i'), false)""")
def filter_result_count(t):
    """A3: size of a filtered list."""
    df = flt.filter_regex(lists.vacinacoes(t, ordered=False), {"nome_vacina": "ring"})
    return flt.result_count(df)


@query("campanhas_ativas", f"""
    SELECT id_campanha, nome, doenca_alvo, tipo_vacina, data_inicio, data_fim, publico_alvo
    FROM campanha
    WHERE (data_fim IS NULL OR data_fim >= {AS_OF_SQL}) AND data_inicio <= {AS_OF_SQL}""")
def campanhas_ativas(t):
    """F6 with as_of = 1998-06-01."""
    return flt.campanhas_ativas(t["campanha"], AS_OF)


@query("vacinas_validas", f"""
    SELECT id_vacina, nome, doenca_alvo, codigo_lote, qtd_doses, data_validade, data_chegada
    FROM vacina WHERE data_validade >= {AS_OF_SQL}""")
def vacinas_validas(t):
    """F7 with as_of = 1998-06-01."""
    return flt.vacinas_validas(t["vacina"], AS_OF)


@query("page_vacinacoes", """
    SELECT * FROM (""" + VACINACOES_SQL + """) x
    ORDER BY data_aplicacao DESC NULLS FIRST, nome_cidadao ASC NULLS LAST, nome_vacina ASC NULLS LAST,
             id_vacinacao ASC
    LIMIT 10 OFFSET 30""")
def page_vacinacoes(t):
    """O3: the fourth page of ten doses in the list's total order."""
    return flt.page(lists.vacinacoes(t, ordered=False), lists.VACINACOES_ORDER, n=3, size=10)


@query("page_jump_vacinacoes", """
    SELECT * FROM (""" + VACINACOES_SQL + """) x
    ORDER BY data_aplicacao DESC NULLS FIRST, nome_cidadao ASC NULLS LAST, nome_vacina ASC NULLS LAST,
             id_vacinacao ASC
    LIMIT 25 OFFSET 1500""")
def page_jump_vacinacoes(t):
    """O3: page 60 of 25 doses of the list laid out in ranges."""
    df = lists.vacinacoes(t, ordered=False)
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/pages-{uuid.uuid4().hex}"
    paging.lay_out(df, lists.VACINACOES_ORDER, path)
    return paging.jump(df.sparkSession, path, df.schema, lists.VACINACOES_ORDER, n=60, size=25)


# The row that ends a page somewhere in the middle of the list.
_PAGE_LAST = {"data_aplicacao": "1997-03-15", "nome_cidadao": "Customer#000000070", "nome_vacina": "n", "id_vacinacao": 4000}


@query("page_after_vacinacoes", """
    SELECT * FROM (""" + VACINACOES_SQL + """) x
    WHERE data_aplicacao < DATE '1997-03-15' OR (data_aplicacao = DATE '1997-03-15'
          AND (nome_cidadao, nome_vacina, id_vacinacao) > ('Customer#000000070', 'n', 4000))
    ORDER BY data_aplicacao DESC, nome_cidadao ASC, nome_vacina ASC, id_vacinacao ASC
    LIMIT 10""")
def page_after_vacinacoes(t):
    """O3: the ten doses that follow a given row, found by its key values."""
    return flt.page_after(lists.vacinacoes(t, ordered=False), lists.VACINACOES_ORDER, _PAGE_LAST, size=10)


# ---------------------------------------------------------------- P3–P7 labels and text

@query("labels_vacina", f"""
    SELECT label, max(id_vacina) AS id_vacina
    FROM (SELECT format('{{}} (Lote: {{}}, Doses: {{}})', nome, codigo_lote, qtd_doses) AS label, id_vacina
          FROM vacina WHERE data_validade >= {AS_OF_SQL}) x
    GROUP BY label""")
def labels_vacina(t):
    """P5 + P6: dose-form lot labels over unexpired lots; equal labels have one
    name, so the later row in list order is the one with the larger id."""
    return lists.labels_vacina(t, AS_OF)


@query("labels_local", """
    SELECT nome || ' (' || cidade || ')' AS label, max(id_local) AS id_local FROM local GROUP BY nome, cidade""")
def labels_local(t):
    """P5 + P6: site labels, the later site wins."""
    return lists.labels_local(t)


@query("labels_campanha", f"""
    SELECT nome || ' (ID: ' || cast(id_campanha AS varchar) || ')' AS label, id_campanha
    FROM campanha WHERE (data_fim IS NULL OR data_fim >= {AS_OF_SQL}) AND data_inicio <= {AS_OF_SQL}""")
def labels_campanha(t):
    return lists.labels_campanha(t, AS_OF)


@query("labels_cidadao", """
    SELECT u.nome || ' (' || c.cpf || ')' AS label, c.cpf FROM cidadao c JOIN usuario u ON c.cpf = u.cpf""")
def labels_cidadao(t):
    return lists.labels_cidadao(t)


@query("labels_agendamento_vacina", f"""
    SELECT label, id_vacina FROM (
        SELECT nome || ' (Lote: ' || codigo_lote || ')' AS label, id_vacina,
               row_number() OVER (PARTITION BY nome || ' (Lote: ' || codigo_lote || ')'
                                  ORDER BY nome DESC, id_vacina DESC) AS rn
        FROM vacina WHERE data_validade >= {AS_OF_SQL}) x
    WHERE rn = 1""")
def labels_agendamento_vacina(t):
    """Of equal labels the later one in list order wins."""
    return lists.labels_agendamento_vacina(t, AS_OF)


@query("labels_agendamento_campanha", f"""
    SELECT label, id_campanha FROM (
        SELECT nome AS label, id_campanha,
               row_number() OVER (PARTITION BY nome ORDER BY data_inicio ASC, id_campanha DESC) AS rn
        FROM campanha
        WHERE (data_fim IS NULL OR data_fim >= {AS_OF_SQL}) AND data_inicio <= {AS_OF_SQL}) x
    WHERE rn = 1""")
def labels_agendamento_campanha(t):
    return lists.labels_agendamento_campanha(t, AS_OF)


@query("format_dates", """
    SELECT id_vacina, nome, doenca_alvo, codigo_lote,
           strftime(data_chegada, '%d/%m/%Y') AS data_chegada, strftime(data_validade, '%d/%m/%Y') AS data_validade,
           qtd_doses
    FROM vacina""")
def format_dates(t):
    """P3 on the lot list."""
    return lists.format_dates(t["vacina"], ["data_chegada", "data_validade"])


def _date_text_inputs(t):
    """Text dates derived from each lot, by its id: day first or year first, with and without zeros in front,
    an impossible day (31/02), or another separator."""
    k = F.col("id_vacina") % 6
    text = F.concat(F.lit("31/02/"), F.date_format("data_validade", "yyyy"))
    for i, form in ((0, "dd/MM/yyyy"), (1, "yyyy-MM-dd"), (3, "d/M/yyyy"), (4, "yyyy-M-d"), (5, "dd.MM.yyyy")):
        text = F.when(k == i, F.date_format("data_validade", form)).otherwise(text)
    return t["vacina"].select("id_vacina", text.alias("data_texto"))


@query("parse_dates", r"""
    SELECT id_vacina, data_texto,
           CASE WHEN regexp_full_match(data_texto, '\d{1,2}/\d{1,2}/\d{4}')
                THEN try_cast(split_part(data_texto, '/', 3) || '-' || lpad(split_part(data_texto, '/', 2), 2, '0') || '-'
                              || lpad(split_part(data_texto, '/', 1), 2, '0') AS date)
                WHEN regexp_full_match(data_texto, '\d{4}-\d{1,2}-\d{1,2}')
                THEN try_cast(split_part(data_texto, '-', 1) || '-' || lpad(split_part(data_texto, '-', 2), 2, '0') || '-'
                              || lpad(split_part(data_texto, '-', 3), 2, '0') AS date) END AS data_validade
    FROM (SELECT id_vacina,
                 CASE id_vacina % 6 WHEN 0 THEN strftime(data_validade, '%d/%m/%Y')
                                    WHEN 1 THEN strftime(data_validade, '%Y-%m-%d')
                                    WHEN 2 THEN '31/02/' || strftime(data_validade, '%Y')
                                    WHEN 3 THEN strftime(data_validade, '%-d/%-m/%Y')
                                    WHEN 4 THEN strftime(data_validade, '%Y-%-m-%-d')
                                    ELSE strftime(data_validade, '%d.%m.%Y') END AS data_texto
          FROM vacina) x""")
def parse_dates(t):
    """d/M/yyyy, else yyyy-M-d, else NULL."""
    from ..functions import columns as C
    return _date_text_inputs(t).withColumn("data_validade", C.parse_date("data_texto"))


@query("normalize_cpf", r"""
    SELECT cpf, regexp_replace(cpf_digitado, '^\s+|\s+$', '', 'g') AS cpf_normalizado
    FROM (SELECT cpf,
                 CASE cast(substr(cpf, 11, 1) AS integer) % 4
                      WHEN 0 THEN '  ' || cpf || ' '
                      WHEN 1 THEN chr(9) || cpf || chr(10)
                      WHEN 2 THEN cpf
                      ELSE ' ' || chr(9) || ' ' || cpf END AS cpf_digitado
          FROM usuario) x""")
def normalize_cpf(t):
    """Typed cpfs with blanks, tabs and newlines at the ends, stripped."""
    from ..functions import columns as C
    u = t["usuario"]
    d = F.substring("cpf", 11, 1).cast("int") % 4
    typed = (F.when(d == 0, F.concat(F.lit("  "), "cpf", F.lit(" ")))
             .when(d == 1, F.concat(F.lit("\t"), "cpf", F.lit("\n")))
             .when(d == 2, F.col("cpf"))
             .otherwise(F.concat(F.lit(" \t "), "cpf")))
    return u.select("cpf", C.strip_ws(typed).alias("cpf_normalizado"))


# ---------------------------------------------------------------- S2

@query("param_lookup", """
    SELECT id_vacina, nome, qtd_doses FROM vacina WHERE doenca_alvo = 'SMALL' AND qtd_doses > 40""")
def param_lookup(t):
    """Named-parameter SQL over DataFrames (no text pasting, no global views)."""
    return tables.param_lookup(
        t.spark, "SELECT id_vacina, nome, qtd_doses FROM {vacina} WHERE doenca_alvo = :doenca AND qtd_doses > :min_doses",
        {"doenca": "SMALL", "min_doses": 40}, vacina=t["vacina"])


# ---------------------------------------------------------------- V1–V7, A1, A2, J6

@query("eligibility", """
    SELECT r.req_seq, r.cpf, r.id_campanha,
           CASE WHEN c.id_campanha IS NULL THEN false WHEN z.cpf IS NULL THEN false
                WHEN z.cidade IS NULL THEN false
                WHEN contains(lower(c.publico_alvo), lower(z.cidade)) OR contains(lower(c.publico_alvo), 'geral')
                THEN true ELSE false END AS ok,
           CASE WHEN c.id_campanha IS NULL THEN 'invalid_campaign' WHEN z.cpf IS NULL THEN 'not_citizen'
                WHEN z.cidade IS NULL THEN 'error_null_city'
                WHEN contains(lower(c.publico_alvo), lower(z.cidade)) OR contains(lower(c.publico_alvo), 'geral')
                THEN NULL ELSE 'not_target' END AS reason,
           CASE WHEN c.id_campanha IS NULL THEN 'Campanha inválida.'
                WHEN z.cpf IS NULL THEN 'CPF não cadastrado como cidadão.'
                WHEN z.cidade IS NULL THEN 'Erro na validação do cidadão: cidade não informada.'
                WHEN contains(lower(c.publico_alvo), lower(z.cidade)) OR contains(lower(c.publico_alvo), 'geral')
                THEN ''
                ELSE 'Cidadão de ' || upper(substr(lower(z.cidade), 1, 1)) || lower(substr(lower(z.cidade), 2))
                     || ' não se encaixa no público alvo da campanha (' || lower(c.publico_alvo) || ').' END AS message
    FROM (SELECT req_seq, cpf, id_campanha FROM vacinacao_request) r
    LEFT JOIN campanha c ON r.id_campanha = c.id_campanha
    LEFT JOIN (SELECT ci.cpf, ci.cidade FROM cidadao ci JOIN usuario u ON ci.cpf = u.cpf) z ON r.cpf = z.cpf""")
def eligibility(t):
    """V1 for every (cpf, campaign) of the dose requests."""
    from ..operators import rules
    req = t["vacinacao_request"].select("req_seq", "cpf", "id_campanha")
    return rules.eligibility(req, t["campanha"], t["cidadao"], t["usuario"])


@query("stock_check", """
    SELECT r.req_seq, r.id_vacina,
           v.id_vacina IS NOT NULL AND v.qtd_doses > 0 AS ok,
           CASE WHEN v.id_vacina IS NULL THEN 'invalid_vaccine' WHEN v.qtd_doses <= 0 THEN 'no_stock' END AS reason
    FROM vacinacao_request r LEFT JOIN vacina v ON r.id_vacina = v.id_vacina""")
def stock_check(t):
    """V2 for every dose request (opening stock, one request at a time)."""
    from ..operators import rules
    return rules.stock_check(t["vacinacao_request"].select("req_seq", "id_vacina"), t["vacina"])


@query("agendamentos_por_local_dia", """
    SELECT id_local, data_agendamento, cast(count(*) AS bigint) AS n_agendamentos
    FROM agendamento GROUP BY id_local, data_agendamento""")
def agendamentos_por_local_dia(t):
    """A1/V4 for all (site, day) pairs."""
    from ..operators import rules
    return rules.bookings_per_site_day(t["agendamento"])


@query("slot_availability", """
    SELECT b.id_local, b.data_agendamento, b.booked, coalesce(l.capacidade, 0) AS capacity,
           cast(greatest(coalesce(l.capacidade, 0) - b.booked, 0) AS bigint) AS free,
           b.booked >= coalesce(l.capacidade, 0) AS full
    FROM (SELECT id_local, data_agendamento, cast(count(*) AS bigint) AS booked
          FROM agendamento GROUP BY id_local, data_agendamento) b
    LEFT JOIN local l ON b.id_local = l.id_local""")
def slot_availability(t):
    """V3 + V4: seats per (site, day)."""
    from ..operators import rules
    return rules.slot_availability(t["agendamento"], t["local"])


@query("campaign_period_check", """
    SELECT d.id_vacinacao, d.id_campanha, d.data_aplicacao,
           c.id_campanha IS NOT NULL AND d.data_aplicacao BETWEEN c.data_inicio
               AND coalesce(c.data_fim, DATE '9999-12-31') AS ok,
           CASE WHEN c.id_campanha IS NULL THEN 'invalid_campaign'
                WHEN NOT (d.data_aplicacao BETWEEN c.data_inicio AND coalesce(c.data_fim, DATE '9999-12-31'))
                THEN 'out_of_period' END AS reason
    FROM vacinacao d LEFT JOIN campanha c ON d.id_campanha = c.id_campanha""")
def campaign_period_check(t):
    """V5 on every dose."""
    from ..operators import rules
    req = t["vacinacao"].select("id_vacinacao", "id_campanha", "data_aplicacao")
    return rules.campaign_period_check(req, t["campanha"], day_col="data_aplicacao")


@query("duplicate_check", """
    SELECT r.req_seq, r.cpf, r.id_vacina, r.data_agendamento,
           NOT EXISTS (SELECT 1 FROM agendamento a WHERE a.cpf = r.cpf AND a.id_vacina = r.id_vacina
                       AND a.data_agendamento = r.data_agendamento) AS ok,
           CASE WHEN EXISTS (SELECT 1 FROM agendamento a WHERE a.cpf = r.cpf AND a.id_vacina = r.id_vacina
                       AND a.data_agendamento = r.data_agendamento) THEN 'duplicate' END AS reason
    FROM (SELECT id_agendamento AS req_seq, cpf, id_vacina, data_agendamento FROM agendamento_all) r""")
def duplicate_check(t):
    """V6: every appointment request (citizens or not) against the table."""
    from ..operators import rules
    req = t["agendamento_all"].select(F.col("id_agendamento").alias("req_seq"), "cpf", "id_vacina", "data_agendamento")
    return rules.duplicate_check(req, t["agendamento"])


@query("agendamentos_duplicados", """
    SELECT cpf, id_vacina, data_agendamento, cast(count(*) AS bigint) AS n_agendamentos
    FROM (SELECT cpf, id_vacina, data_agendamento FROM agendamento
          UNION ALL
          SELECT lpad(cast(o_custkey AS varchar), 11, '0'), cast(l_partkey + 1 AS bigint), cast(o_orderdate AS date)
          FROM dose_line WHERE l_linenumber = 2 AND o_custkey % 10 <= 6
          UNION ALL
          SELECT cpf, id_vacina, data_agendamento FROM agendamento WHERE id_agendamento % 9 = 0) x
    GROUP BY cpf, id_vacina, data_agendamento HAVING count(*) >= 2""")
def agendamentos_duplicados(t):
    """A2: (cpf, lot, day) groups booked more than once, over the appointments,
    the second line of each order booked on the same day, and every ninth
    appointment booked again."""
    from ..operators import rules
    d = t["dose_line"].where((F.col("l_linenumber") == 2) & (F.col("o_custkey") % 10 <= 6)).select(
        fx.cpf("o_custkey").alias("cpf"), (F.col("l_partkey") + 1).cast("bigint").alias("id_vacina"),
        F.col("o_orderdate").cast("date").alias("data_agendamento"))
    booked = t["agendamento"].select("id_agendamento", "cpf", "id_vacina", "data_agendamento")
    a = booked.drop("id_agendamento").unionByName(d).unionByName(
        booked.where(F.col("id_agendamento") % 9 == 0).drop("id_agendamento"))
    return rules.duplicate_groups(a)


@query("cidadao_exists", """
    SELECT r.req_seq, r.cpf, EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf) AS "exists"
    FROM vacinacao_request r""")
def cidadao_exists(t):
    """V7 for every dose request."""
    from ..operators import rules
    return rules.cidadao_exists(t["vacinacao_request"].select("req_seq", "cpf"), t["cidadao"])


@query("unreferenced_vacinas", """
    SELECT * FROM vacina v
    WHERE NOT EXISTS (SELECT 1 FROM vacinacao d WHERE d.id_vacina = v.id_vacina)""")
def unreferenced_vacinas(t):
    """Lots no dose uses."""
    from ..operators import rules
    return rules.unreferenced(t["vacina"], "id_vacina", (t["vacinacao"], "id_vacina"))


@query("unreferenced_campanhas", """
    SELECT * FROM campanha c WHERE NOT EXISTS (SELECT 1 FROM vacinacao d WHERE d.id_campanha = c.id_campanha)""")
def unreferenced_campanhas(t):
    from ..operators import rules
    return rules.unreferenced(t["campanha"], "id_campanha", (t["vacinacao"], "id_campanha"))


@query("unreferenced_locais", """
    SELECT * FROM local l
    WHERE NOT EXISTS (SELECT 1 FROM vacinacao d WHERE d.id_local = l.id_local)
      AND NOT EXISTS (SELECT 1 FROM agendamento a WHERE a.id_local = l.id_local)""")
def unreferenced_locais(t):
    from ..operators import rules
    return rules.unreferenced(t["local"], "id_local", (t["vacinacao"], "id_local"), (t["agendamento"], "id_local"))


@query("deletable_usuarios", """
    SELECT * FROM usuario u
    WHERE NOT EXISTS (SELECT 1 FROM vacinacao d WHERE d.cpf = u.cpf)
      AND NOT EXISTS (SELECT 1 FROM agendamento a WHERE a.cpf = u.cpf)
      AND NOT EXISTS (SELECT 1 FROM parente p WHERE p.cpf_responsavel = u.cpf OR p.cpf_parente = u.cpf)""")
def deletable_usuarios(t):
    """Users with no dose, appointment or family link."""
    from ..operators import rules
    return rules.deletable_usuarios(t["usuario"], t["vacinacao"], t["agendamento"], t["parente"])


# ---------------------------------------------------------------- K1, K2, K4, K6

def _audit_tables(t, **swap):
    from ..sources.schemas import TABLES
    out = {n: t[n] for n in TABLES}
    out.update({k: t[v] for k, v in swap.items()})
    return out


def _sql_union(parts):
    return "\nUNION ALL\n".join(parts)


def _audit_pk_sql(swap):
    from ..sources.schemas import TABLES
    parts = []
    for name, spec in TABLES.items():
        k = spec.key[0]
        src = swap.get(name, name)
        parts.append(f"SELECT '{name}' AS table_name, cast({k} AS varchar) AS key_value, "
                     f"cast(count(*) AS bigint) AS n_rows FROM {src} GROUP BY {k} "
                     f"HAVING count(*) > 1 OR {k} IS NULL")
    return _sql_union(parts)


def _audit_fk_sql(swap):
    from ..sources.schemas import TABLES
    parts = []
    for name, spec in TABLES.items():
        src = swap.get(name, name)
        for fk in spec.foreign_keys:
            c, rc = fk.columns[0], fk.ref_columns[0]
            parts.append(
                f"SELECT '{name}' AS table_name, '{c}' AS fk_columns, '{fk.ref_table}' AS ref_table, "
                f"cast(x.{c} AS varchar) AS fk_value, cast(count(*) AS bigint) AS n_rows FROM {src} x "
                f"WHERE NOT EXISTS (SELECT 1 FROM {swap.get(fk.ref_table, fk.ref_table)} p WHERE p.{rc} = x.{c}) GROUP BY x.{c}")
    return _sql_union(parts)


def _audit_columns_sql(swap):
    from ..sources.schemas import TABLES
    parts = []
    for name, spec in TABLES.items():
        src = swap.get(name, name)
        for c in spec.not_null:
            parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, 'not_null' AS rule, "
                         f"cast(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS bigint) AS n_violations FROM {src}")
        for c, n in spec.lengths.items():
            parts.append(f"SELECT '{name}', '{c}', 'max_length_{n}', "
                         f"cast(sum(CASE WHEN length({c}) > {n} THEN 1 ELSE 0 END) AS bigint) FROM {src}")
    return _sql_union(parts)


AUDIT_RANGES_SQL = """
    SELECT 'vacina' AS table_name, 'codigo_lote' AS column_name, 'non_negative_integer' AS rule,
           cast(sum(CASE WHEN coalesce(regexp_full_match(codigo_lote, '[0-9]+'), false) THEN 0 ELSE 1 END) AS bigint)
           AS n_violations FROM vacina_bad
    UNION ALL SELECT 'vacina', 'qtd_doses', 'min_0', cast(sum(CASE WHEN qtd_doses < 0 THEN 1 ELSE 0 END) AS bigint)
    FROM vacina_bad
    UNION ALL SELECT 'local', 'numero', 'min_1', cast(sum(CASE WHEN numero < 1 THEN 1 ELSE 0 END) AS bigint) FROM local_bad
    UNION ALL SELECT 'local', 'capacidade', 'min_0', cast(sum(CASE WHEN capacidade < 0 THEN 1 ELSE 0 END) AS bigint) FROM local_bad
    UNION ALL SELECT 'local', 'estado', 'max_length_2', cast(sum(CASE WHEN length(estado) > 2 THEN 1 ELSE 0 END) AS bigint)
    FROM local_bad
    UNION ALL SELECT 'vacinacao', 'contagem', 'min_1', cast(sum(CASE WHEN contagem < 1 THEN 1 ELSE 0 END) AS bigint)
    FROM vacinacao_bad
    UNION ALL SELECT 'campanha', 'tipo_vacina', 'in_options',
           cast(sum(CASE WHEN tipo_vacina IN ('Dose Única', 'Múltiplas Doses') THEN 0 ELSE 1 END) AS bigint)
    FROM campanha_bad"""

_PK_SWAP = {"vacinacao": "vacinacao_raw"}
_FK_SWAP = {"vacinacao": "vacinacao_bad", "agendamento": "agendamento_bad", "parente": "parente_all",
            "cidadao": "cidadao_bad"}
_BAD = {n: f"{n}_bad" for n in ("usuario", "vacina", "local", "campanha", "vacinacao")}


@query("audit_pk", _audit_pk_sql(_PK_SWAP))
def audit_pk(t):
    """K1 over all ten tables; doses loaded without the keep-first rule."""
    from ..operators import integrity
    return integrity.audit_pk(_audit_tables(t, **_PK_SWAP))


@query("audit_fk", _audit_fk_sql(_FK_SWAP))
def audit_fk(t):
    """K2 over all foreign keys; facts without the citizen filter and with some
    keys of no parent."""
    from ..operators import integrity
    return integrity.audit_fk(_audit_tables(t, **_FK_SWAP))


@query("audit_columns", _audit_columns_sql(_BAD))
def audit_columns(t):
    """K4: NOT NULL and VARCHAR length counts for every column, on tables with faults."""
    from ..operators import integrity
    return integrity.audit_columns(_audit_tables(t, **_BAD))


@query("audit_ranges", AUDIT_RANGES_SQL)
def audit_ranges(t):
    """K6: widget ranges, on tables with faults."""
    from ..operators import integrity
    return integrity.audit_ranges(_audit_tables(t, **_BAD))


# Change operators register themselves on import.
from . import change_queries  # noqa: E402,F401
