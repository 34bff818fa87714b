"""Independent SQL formulations of the registered queries, for DuckDB.

The driver registers the raw parquet tables as views; every statement starts
with the same binding CTEs (FIXTURES.md §2) that turn them into the ten
programme tables and the request batches. The binding text is input; the
operator itself is written separately here in SQL and in DataFrame code in
``imunis.plans.catalog``.
"""

from __future__ import annotations

SPARE, UNKNOWN = 10**15, 2 * 10**15
CPF = "lpad(cast({k} AS varchar), 11, '0')"

BINDINGS: dict[str, str] = {
    "usuario": f"""
        SELECT {CPF.format(k='c_custkey')} AS cpf, c_name AS nome,
               '(' || lpad(cast(c_nationkey AS varchar), 2, '0') || ') 9'
                   || lpad(cast(c_custkey AS varchar), 8, '0') AS telefone
        FROM customer""",
    "cidadao": f"""
        SELECT {CPF.format(k='c_custkey')} AS cpf,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lpad(cast(c_custkey AS varchar), 15, '7') END AS cartao_sus,
               'Rua ' || cast(c_custkey % 50 AS varchar) AS rua,
               c_mktsegment AS bairro,
               cast(c_custkey % 1000 AS integer) AS numero,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE n_name END AS cidade,
               substr(r_name, 1, 2) AS estado
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE c_custkey % 10 <= 6""",
    "administrador": f"""
        SELECT {CPF.format(k='c_custkey')} AS cpf, 'Posto ' || cast(c_custkey % 100 AS varchar) AS local_trabalho
        FROM customer WHERE c_custkey % 10 IN (6, 7)""",
    "agente_saude": f"""
        SELECT {CPF.format(k='c_custkey')} AS cpf, 'agente' || cast(c_custkey AS varchar) || '@x.br' AS email,
               'Posto ' || cast(c_custkey % 100 AS varchar) AS posto_trabalho
        FROM customer WHERE c_custkey % 10 IN (7, 8)""",
    "vacina": f"""
        SELECT cast(lot AS bigint) AS id_vacina, p_name AS nome, p_type AS doenca_alvo,
               regexp_replace(p_brand, '[^0-9]', '', 'g') AS codigo_lote,
               cast(date '1995-01-01' + cast(p_partkey % 1500 AS integer) AS date) AS data_chegada,
               cast(date '1995-01-01' + cast(p_partkey % 1500 + 30 * p_size AS integer) AS date) AS data_validade,
               cast(p_size - 1 AS integer) AS qtd_doses
        FROM (SELECT *, p_partkey + 1 AS lot FROM part
              UNION ALL SELECT *, p_partkey + {SPARE} FROM part WHERE p_partkey % 20 = 7) p""",
    "local": f"""
        SELECT cast(site AS bigint) AS id_local, s_name AS nome,
               'Rua ' || cast(s_suppkey % 50 AS varchar) AS rua,
               'Bairro ' || cast(s_suppkey % 20 AS varchar) AS bairro,
               cast(s_suppkey + 1 AS integer) AS numero, n_name AS cidade,
               'R' || cast(n_regionkey AS varchar) AS estado,
               '(11) 9' || lpad(cast(s_suppkey AS varchar), 8, '0') AS contato,
               CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE cast(1 + s_suppkey % 4 AS integer) END AS capacidade
        FROM (SELECT *, s_suppkey + 1 AS site FROM supplier
              UNION ALL SELECT *, s_suppkey + {SPARE} FROM supplier WHERE s_suppkey % 10 = 3) s
        JOIN nation ON s_nationkey = n_nationkey""",
    "campanha": """
        SELECT cast(n_nationkey + 1 AS integer) AS id_campanha, 'Campanha ' || n_name AS nome,
               CASE n_nationkey % 5 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM'
                    WHEN 3 THEN 'STANDARD' ELSE 'LARGE' END AS doenca_alvo,
               CASE WHEN n_nationkey % 2 = 0 THEN 'Dose Única' ELSE 'Múltiplas Doses' END AS tipo_vacina,
               cast(date '1995-06-01' + cast(60 * n_nationkey AS integer) AS date) AS data_inicio,
               CASE WHEN n_nationkey % 5 = 0 THEN NULL
                    ELSE cast(date '1995-06-01' + cast(60 * n_nationkey + 400 AS integer) AS date) END AS data_fim,
               CASE WHEN n_nationkey % 4 = 0 THEN 'População geral' ELSE 'Moradores de ' || n_name END AS publico_alvo
        FROM nation""",
    "dose_line": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey, o_orderdate
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
                     row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                        ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn
              FROM lineitem) x
        JOIN orders ON l_orderkey = o_orderkey
        WHERE rn = 1""",
    "vacinacao_all": f"""
        SELECT cast(l_orderkey * 8 + l_linenumber AS bigint) AS id_vacinacao,
               cast(l_linenumber AS integer) AS contagem, cast(l_shipdate AS date) AS data_aplicacao,
               cast(l_partkey + 1 AS bigint) AS id_vacina, {CPF.format(k='o_custkey')} AS cpf,
               cast(l_suppkey + 1 AS bigint) AS id_local, cast(l_orderkey % 22 + 1 AS integer) AS id_campanha,
               o_custkey
        FROM dose_line WHERE l_linenumber <= 4""",
    "vacinacao": """
        SELECT id_vacinacao, contagem, data_aplicacao, id_vacina, cpf, id_local, id_campanha
        FROM vacinacao_all WHERE o_custkey % 10 <= 6""",
    "vacinacao_raw": f"""
        SELECT cast(l_orderkey * 8 + l_linenumber AS bigint) AS id_vacinacao,
               cast(l_linenumber AS integer) AS contagem, cast(l_shipdate AS date) AS data_aplicacao,
               cast(l_partkey + 1 AS bigint) AS id_vacina, {CPF.format(k='o_custkey')} AS cpf,
               cast(l_suppkey + 1 AS bigint) AS id_local, cast(l_orderkey % 22 + 1 AS integer) AS id_campanha
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_linenumber <= 4 AND o_custkey % 10 <= 6""",
    "vacinacao_request": f"""
        SELECT cast(l_orderkey * 8 + l_linenumber AS bigint) AS req_seq,
               cast(CASE WHEN l_orderkey % 53 = 0 THEN 0 ELSE l_linenumber END AS integer) AS contagem,
               CASE WHEN l_orderkey % 61 <> 0 THEN cast(l_shipdate AS date) END AS data_aplicacao,
               cast(l_partkey + CASE WHEN l_orderkey % 43 = 0 THEN {UNKNOWN} ELSE 1 END AS bigint) AS id_vacina,
               CASE WHEN l_orderkey % 67 = 0 THEN '' ELSE {CPF.format(k='o_custkey')} END AS cpf,
               cast(l_suppkey + 1 AS bigint) AS id_local, cast(l_orderkey % 27 + 1 AS integer) AS id_campanha
        FROM dose_line WHERE l_linenumber >= 5""",
    "agendamento_all": f"""
        SELECT cast(l_orderkey AS bigint) AS id_agendamento, cast(o_orderdate AS date) AS data_agendamento,
               cast(CASE WHEN l_orderkey % 23 = 0 THEN (l_partkey // 20) * 20 + 7 + {SPARE} ELSE l_partkey + 1 END AS bigint)
               AS id_vacina, cast(l_suppkey + 1 AS bigint) AS id_local,
               {CPF.format(k='o_custkey')} AS cpf, o_custkey
        FROM dose_line WHERE l_linenumber = 1""",
    "agendamento": """
        SELECT id_agendamento, data_agendamento, id_vacina, id_local, cpf
        FROM agendamento_all WHERE o_custkey % 10 <= 6""",
    "parente_all": f"""
        SELECT cast(c_custkey AS bigint) AS id_parentesco, {CPF.format(k='c_custkey')} AS cpf_responsavel,
               {CPF.format(k='c_custkey + 1')} AS cpf_parente, c_custkey
        FROM customer""",
    "parente": """
        SELECT id_parentesco, cpf_responsavel, cpf_parente FROM parente_all WHERE c_custkey % 10 <= 5""",
}


def with_bindings(body: str, extra: dict[str, str] | None = None) -> str:
    ctes = dict(BINDINGS)
    if extra:
        ctes.update(extra)
    parts = [f"{name} AS ({sql.strip()})" for name, sql in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


# Change-request batches (same derivations as imunis.sources.requests).
_K = "c_custkey"
_USER_PAYLOAD = """
        lpad(cast(c_custkey AS varchar), 15, '8') AS cartao_sus,
        'Rua Nova ' || cast(c_custkey % 30 AS varchar) AS rua,
        c_mktsegment AS bairro,
        cast(c_custkey % 500 AS integer) AS numero,
        'Cidade ' || cast(c_nationkey AS varchar) AS cidade,
        'SP' AS estado,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'Posto ' || cast(c_custkey % 100 AS varchar) END AS local_trabalho,
        'novo' || cast(c_custkey AS varchar) || '@x.br' AS email,
        'Posto ' || cast(c_custkey % 100 AS varchar) AS posto_trabalho"""
_ROLE3 = "CASE {e} WHEN 0 THEN 'Cidadão' WHEN 1 THEN 'Administrador' ELSE 'Agente de Saúde' END"
_VAC_FIELDS = """
        CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 29 = 0 THEN repeat({name}, 15) ELSE {name} END AS nome,
        p_type AS doenca_alvo,
        CASE WHEN p_partkey % 19 = 0 THEN '0' WHEN p_partkey % 23 = 0 THEN p_brand
             ELSE regexp_replace(p_brand, '[^0-9]', '', 'g') END AS codigo_lote,
        cast(date '1996-01-01' + cast(p_partkey % 300 AS integer) AS date) AS data_chegada,
        cast(date '1996-01-01' + cast(p_partkey % 300 + p_size - 10 AS integer) AS date) AS data_validade,
        CASE WHEN p_partkey % 31 <> 0 THEN cast(p_size - 5 AS integer) END AS qtd_doses"""
_CAMP_FIELDS = """
        '{prefix}' || repeat(c_name, CASE WHEN c_custkey % 13 = 0 THEN 7 ELSE 1 END) AS nome, c_mktsegment AS doenca_alvo,
        CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Dose Única' ELSE 'Múltiplas Doses' END AS tipo_vacina,
        cast(date '1996-01-01' + cast(c_custkey % 365 AS integer) AS date) AS data_inicio,
        CASE WHEN c_custkey % 3 = 0 THEN NULL
             ELSE cast(date '1996-01-01' + cast(c_custkey % 365 + (c_custkey % 7 - 2) * 30 AS integer) AS date) END
             AS data_fim,
        CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'Moradores de NATION_' || cast(c_nationkey AS varchar) END
             AS publico_alvo"""
_LOCAL_FIELDS = """
        'Posto ' || repeat(s_name, CASE WHEN s_suppkey % 8 = 4 THEN 6 ELSE 1 END) AS nome, 'Rua ' || cast(s_suppkey % 50 AS varchar) AS rua,
        'Bairro ' || cast(s_suppkey % 20 AS varchar) AS bairro,
        cast(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey + 1 END AS integer) AS numero,
        'Cidade ' || cast(s_nationkey AS varchar) AS cidade,
        CASE WHEN s_suppkey % 11 = 0 THEN 'RJX' ELSE 'R' || cast(s_suppkey % 5 AS varchar) END AS estado,
        '(21) 9' || lpad(cast(s_suppkey AS varchar), 8, '0') AS contato,
        cast(s_suppkey % 5 - 2 AS integer) AS capacidade"""

_TYPED_CPF = f"""CASE WHEN l_orderkey % 47 = 0 THEN '' WHEN l_orderkey % 41 = 0 THEN '   '
                    WHEN l_orderkey % 53 = 0 THEN repeat({CPF.format(k='o_custkey')}, 2)
                    WHEN l_orderkey % 3 = 0 THEN ' ' || {CPF.format(k='o_custkey')}
                    ELSE {CPF.format(k='o_custkey')} END"""

BINDINGS.update({
    "usuario_insert_req": f"""
        SELECT cast(c_custkey AS bigint) AS req_seq,
               CASE WHEN c_custkey % 5 = 0 THEN '  ' || {CPF.format(k='c_custkey')}
                    ELSE '9' || lpad(cast(c_custkey // 2 AS varchar), 10, '0') END AS cpf,
               CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 29 = 0 THEN repeat(c_name, 7) ELSE c_name END AS nome,
               '(' || lpad(cast(c_nationkey AS varchar), 2, '0') || ') 8' || lpad(cast(c_custkey AS varchar), 8, '0')
                   AS telefone,
               {_ROLE3.format(e='c_custkey % 3')} AS tipo_usuario, {_USER_PAYLOAD}
        FROM customer WHERE c_custkey % 5 IN (0, 1, 2)""",
    "usuario_update_req": f"""
        SELECT cast(c_custkey AS bigint) AS req_seq, own AS cpf,
               CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 16 = 5 THEN {CPF.format(k='c_custkey + 1')}
                    ELSE ' ' || own END AS cpf_digitado,
               CASE WHEN c_custkey % 41 = 0 THEN repeat(c_name, 7) ELSE upper(c_name) END AS nome,
               CASE WHEN c_custkey % 47 <> 0 THEN '(' || lpad(cast(c_nationkey AS varchar), 2, '0') || ') 7'
                   || lpad(cast(c_custkey AS varchar), 8, '0') END AS telefone,
               {_ROLE3.format(e='(c_custkey // 4) % 3')} AS tipo_usuario, {_USER_PAYLOAD}
        FROM (SELECT *, CASE WHEN c_custkey % 43 = 0 THEN '8' || lpad(cast(c_custkey AS varchar), 10, '0')
                             ELSE {CPF.format(k='c_custkey')} END AS own FROM customer) c
        WHERE c_custkey % 4 = 1 OR c_custkey % 20 = 6""",
    "usuario_delete_req": f"""
        SELECT cast(c_custkey * 3 AS bigint) AS req_seq, {CPF.format(k='c_custkey')} AS cpf
        FROM customer WHERE c_custkey % 6 = 0
        UNION ALL
        SELECT cast(c_custkey * 3 + 1 AS bigint), {CPF.format(k='c_custkey')} FROM customer WHERE c_custkey % 12 = 0
        UNION ALL
        SELECT cast(c_custkey * 3 + 2 AS bigint), '9' || lpad(cast(c_custkey AS varchar), 10, '0')
        FROM customer WHERE c_custkey % 18 = 0""",
    "vacina_insert_req": f"""
        SELECT cast(p_partkey AS bigint) AS req_seq, {_VAC_FIELDS.format(name='p_name')}
        FROM part WHERE p_partkey % 4 = 0""",
    "vacina_update_req": f"""
        SELECT cast(p_partkey AS bigint) AS req_seq, cast((p_partkey * 7) % 1009 + CASE WHEN p_partkey % 13 = 0 THEN {UNKNOWN} ELSE 1 END AS bigint) AS id_vacina,
               {_VAC_FIELDS.format(name='upper(p_name)')}
        FROM part WHERE p_partkey % 4 = 1""",
    "vacina_delete_req": f"""
        SELECT cast(p_partkey * 3 AS bigint) AS req_seq, cast(p_partkey + 1 AS bigint) AS id_vacina
        FROM part WHERE p_partkey % 3 = 0
        UNION ALL
        SELECT cast(p_partkey * 3 + 1 AS bigint), cast(p_partkey + {SPARE} AS bigint) FROM part WHERE p_partkey % 20 = 7
        UNION ALL
        SELECT cast(p_partkey * 3 + 2 AS bigint),
               cast(p_partkey + CASE WHEN p_partkey % 80 = 7 THEN {SPARE} ELSE {UNKNOWN} END AS bigint)
        FROM part WHERE p_partkey % 40 = 7""",
    "campanha_insert_req": f"""
        SELECT cast(c_custkey AS bigint) AS req_seq, {_CAMP_FIELDS.format(prefix='Campanha ')}
        FROM customer WHERE c_custkey % 10 = 0""",
    "campanha_update_req": f"""
        SELECT cast(c_custkey AS bigint) AS req_seq, cast(c_custkey % 33 + 1 AS integer) AS id_campanha,
               {_CAMP_FIELDS.format(prefix='Campanha Nova ')}
        FROM customer WHERE c_custkey % 10 = 1""",
    "campanha_delete_req": """
        SELECT cast(c_custkey AS bigint) AS req_seq, cast(c_custkey % 30 + 1 AS integer) AS id_campanha
        FROM customer WHERE c_custkey % 7 = 0""",
    "local_insert_req": f"""
        SELECT cast(s_suppkey AS bigint) AS req_seq, {_LOCAL_FIELDS} FROM supplier WHERE s_suppkey % 3 = 0""",
    "local_update_req": f"""
        SELECT cast(s_suppkey AS bigint) AS req_seq,
               cast(CASE WHEN s_suppkey % 9 = 4 THEN s_suppkey + 2 WHEN s_suppkey % 9 = 7 THEN s_suppkey + {UNKNOWN}
                         ELSE s_suppkey + 1 END AS bigint) AS id_local,
               {_LOCAL_FIELDS}
        FROM supplier WHERE s_suppkey % 3 = 1""",
    "local_delete_req": f"""
        SELECT cast(s_suppkey * 3 AS bigint) AS req_seq, cast(s_suppkey + 1 AS bigint) AS id_local
        FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL
        SELECT cast(s_suppkey * 3 + 1 AS bigint), cast(s_suppkey + {SPARE} AS bigint) FROM supplier WHERE s_suppkey % 10 = 3
        UNION ALL
        SELECT cast(s_suppkey * 3 + 2 AS bigint), cast(s_suppkey + {UNKNOWN} AS bigint) FROM supplier
        WHERE s_suppkey % 10 = 1""",
    "parente_insert_req": f"""
        SELECT cast(c_custkey * 2 + x AS bigint) AS req_seq, {CPF.format(k='c_custkey')} AS cpf_responsavel,
               CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN repeat({CPF.format(k='c_custkey')}, 2)
                    WHEN c_custkey % 3 = 0 THEN {CPF.format(k='c_custkey + 2')}
                    WHEN c_custkey % 3 = 1 THEN {CPF.format(k='c_custkey')}
                    ELSE {CPF.format(k='c_custkey + 1')} END AS cpf_parente
        FROM customer, (SELECT 0 AS x UNION ALL SELECT 1) copies
        WHERE c_custkey % 10 <= 7 AND (x = 0 OR c_custkey % 9 = 0)""",
    "parente_update_req": f"""
        SELECT cast(c_custkey AS bigint) AS req_seq, cast(c_custkey AS bigint) AS id_parentesco,
               {CPF.format(k='c_custkey')} AS cpf_responsavel,
               CASE WHEN c_custkey % 7 = 0 THEN {CPF.format(k='c_custkey')} WHEN c_custkey % 11 = 0 THEN ''
                    WHEN c_custkey % 13 = 0 THEN repeat({CPF.format(k='c_custkey')}, 2)
                    ELSE {CPF.format(k='c_custkey + 3')} END AS cpf_parente
        FROM customer WHERE c_custkey % 2 = 0""",
    "parente_delete_req": """
        SELECT cast(c_custkey * 2 AS bigint) AS req_seq, cast(c_custkey AS bigint) AS id_parentesco
        FROM customer WHERE c_custkey % 4 = 0
        UNION ALL
        SELECT cast(c_custkey * 2 + 1 AS bigint), cast(c_custkey AS bigint) FROM customer WHERE c_custkey % 8 = 0""",
    "agendamento_insert_req": f"""
        SELECT cast(l_orderkey AS bigint) AS req_seq, {_TYPED_CPF} AS cpf,
               cast(l_orderkey % 27 + 1 AS integer) AS id_campanha, cast(l_partkey + 1 AS bigint) AS id_vacina,
               cast(l_suppkey + 1 AS bigint) AS id_local, cast(o_orderdate AS date) AS data_agendamento
        FROM dose_line WHERE l_linenumber = 2""",
    "agendamento_update_req": f"""
        SELECT cast(l_orderkey AS bigint) AS req_seq, cast(l_orderkey AS bigint) AS id_agendamento,
               {_TYPED_CPF} AS cpf, cast(l_orderkey % 27 + 1 AS integer) AS id_campanha, cast(l_partkey + 1 AS bigint) AS id_vacina,
               cast(l_suppkey + 1 AS bigint) AS id_local,
               cast(cast(o_orderdate AS date) + 7 AS date) AS data_agendamento
        FROM dose_line WHERE l_linenumber = 3""",
    "agendamento_delete_req": """
        SELECT cast(l_orderkey AS bigint) AS req_seq, cast(l_orderkey AS bigint) AS id_agendamento
        FROM dose_line WHERE l_linenumber = 1 AND l_orderkey % 3 = 0""",
    "vacinacao_update_req": f"""
        SELECT cast(l_orderkey * 8 + l_linenumber AS bigint) AS req_seq,
               cast(l_orderkey * 8 + l_linenumber + CASE WHEN l_orderkey % 55 = 0 THEN {UNKNOWN} ELSE 0 END AS bigint)
               AS id_vacinacao,
               cast(CASE WHEN l_orderkey % 35 = 0 THEN 0 ELSE l_linenumber END AS integer) AS contagem,
               CASE WHEN l_orderkey % 65 <> 0 THEN cast(l_shipdate AS date) END AS data_aplicacao,
               cast(CASE WHEN l_orderkey % 85 = 0 THEN l_partkey + 1 + {UNKNOWN} WHEN l_orderkey % 2 = 0 THEN l_partkey + 1
                         ELSE ((l_partkey + 1) * 7) % 50 + 1 END AS bigint) AS id_vacina,
               CASE WHEN l_orderkey % 45 = 0 THEN ' ' ELSE {CPF.format(k='o_custkey')} END AS cpf, cast(l_suppkey + 1 AS bigint) AS id_local,
               cast(l_orderkey % 27 + 1 AS integer) AS id_campanha
        FROM dose_line WHERE l_linenumber <= 4 AND l_orderkey % 5 = 0""",
    "vacinacao_delete_req": """
        SELECT cast((l_orderkey * 8 + l_linenumber) * 2 AS bigint) AS req_seq,
               cast(l_orderkey * 8 + l_linenumber AS bigint) AS id_vacinacao
        FROM dose_line WHERE l_linenumber <= 4 AND l_orderkey % 3 = 0
        UNION ALL
        SELECT cast((l_orderkey * 8 + l_linenumber) * 2 + 1 AS bigint), cast(l_orderkey * 8 + l_linenumber AS bigint)
        FROM dose_line WHERE l_linenumber <= 4 AND l_orderkey % 6 = 0""",
})

# Batches whose requests depend on one another.
BINDINGS.update({
    "vacina_scarce": "SELECT * REPLACE (cast(id_vacina % 5 AS integer) AS qtd_doses) FROM vacina",
    "vacinacao_chain_req": f"""
        SELECT cast((l_partkey % 11 * 2 + n) * 10000000000 + l_orderkey * 8 + l_linenumber AS bigint) AS req_seq,
               cast(l_orderkey * 8 + l_linenumber AS bigint) AS id_vacinacao, cast(l_linenumber AS integer) AS contagem,
               cast(l_shipdate AS date) AS data_aplicacao,
               cast(CASE WHEN (l_orderkey + n) % 31 = 0 THEN l_partkey + {UNKNOWN} ELSE l_partkey * (n + 2) % 97 + 2 END AS bigint) AS id_vacina,
               {CPF.format(k='o_custkey')} AS cpf,
               cast(l_suppkey + CASE WHEN (l_orderkey + n) % 13 = 0 THEN {UNKNOWN} ELSE 1 END AS bigint) AS id_local,
               cast(l_orderkey % 27 + 1 AS integer) AS id_campanha
        FROM dose_line, (SELECT unnest([0, 1]) AS n) WHERE l_linenumber <= 4 AND l_orderkey % 13 = 0""",
    "vacinacao_mixed_req": f"""
        SELECT cast((l_partkey % 11 * 3 + n) * 10000000000 + dose AS bigint) AS req_seq,
               CASE WHEN (l_orderkey + n) % 41 = 0 THEN 'merge' WHEN turn = 0 THEN 'insert' WHEN turn = 1 THEN 'update' ELSE 'delete' END AS kind,
               cast(CASE WHEN turn <> 0 THEN dose + CASE WHEN l_orderkey % 55 = 1 THEN {UNKNOWN} ELSE 0 END END AS bigint) AS id_vacinacao,
               cast(CASE WHEN l_orderkey % 35 = 0 THEN 0 ELSE l_linenumber END AS integer) AS contagem,
               CASE WHEN l_orderkey % 65 <> 1 THEN cast(l_shipdate AS date) END AS data_aplicacao,
               cast(CASE WHEN (l_orderkey + n) % 31 = 0 THEN l_partkey + {UNKNOWN} ELSE l_partkey * (n + 2) % 97 + 2 END AS bigint) AS id_vacina,
               CASE WHEN l_orderkey % 45 = 0 THEN ' ' WHEN l_orderkey % 37 = 0 THEN 'nobody' ELSE {CPF.format(k='o_custkey')} END AS cpf,
               cast(l_suppkey + CASE WHEN (l_orderkey + n) % 13 = 2 THEN {UNKNOWN} ELSE 1 END AS bigint) AS id_local,
               cast(l_orderkey % 27 + 1 AS integer) AS id_campanha
        FROM (SELECT *, l_orderkey * 8 + l_linenumber AS dose, (l_orderkey + l_linenumber + n) % 3 AS turn
              FROM dose_line, (SELECT unnest([0, 1, 2]) AS n) WHERE l_linenumber <= 4 AND l_orderkey % 13 = 1) x""",
    "agendamento_chain_req": f"""
        SELECT cast(l_orderkey * 8 + l_linenumber * 3 + n - 3 AS bigint) AS req_seq, {CPF.format(k='o_custkey')} AS cpf,
               cast(l_orderkey % 27 + 1 AS integer) AS id_campanha, cast(l_partkey % 5 + 1 AS bigint) AS id_vacina,
               cast((l_suppkey * 3 + n) % 4 + 2 AS bigint) AS id_local,
               cast(DATE '2001-01-01' + cast(o_custkey % 97 AS integer) AS date) AS data_agendamento
        FROM dose_line, (SELECT unnest([0, 1, 2]) AS n) WHERE l_linenumber <= 2""",
    "usuario_chain_req": f"""
        SELECT cast(n * 10000000000 + k AS bigint) AS req_seq, {CPF.format(k='k')} AS cpf,
               CASE WHEN c_custkey % 29 = 0 THEN 'x' ELSE {CPF.format(k='k')} END AS cpf_digitado,
               c_name || ' ' || cast(n AS varchar) AS nome,
               CASE WHEN c_custkey % 17 <> 0 THEN lpad(cast(k AS varchar), 9, '0') END AS telefone,
               {_ROLE3.format(e='(k // 3 + n * (k % 3)) % 3')} AS tipo_usuario, {_USER_PAYLOAD}
        FROM (SELECT * REPLACE (c_custkey + n AS c_custkey), c_custkey AS k FROM customer, (SELECT unnest([0, 1, 2, 3]) AS n)
              WHERE c_custkey % 3 <> 0) c""",
})

# Tables with faults, for the audits.
BINDINGS.update({
    "usuario_bad": """
        SELECT cpf, CASE WHEN right(cpf, 1) = '3' THEN repeat(nome, 8) ELSE nome END AS nome,
               CASE WHEN right(cpf, 1) <> '7' THEN telefone END AS telefone FROM usuario""",
    "cidadao_bad": """
        SELECT * REPLACE (CASE WHEN numero % 41 = 0 THEN 'X' || cpf ELSE cpf END AS cpf) FROM cidadao""",
    "vacina_bad": """
        SELECT * REPLACE (CASE WHEN id_vacina % 13 = 0 THEN -1 ELSE qtd_doses END AS qtd_doses,
                          CASE WHEN id_vacina % 17 = 0 THEN 'L-' || codigo_lote ELSE codigo_lote END AS codigo_lote,
                          CASE WHEN id_vacina % 19 <> 0 THEN doenca_alvo END AS doenca_alvo) FROM vacina""",
    "local_bad": """
        SELECT * REPLACE (CASE WHEN id_local % 5 = 0 THEN 0 ELSE numero END AS numero,
                          CASE WHEN id_local % 7 = 0 THEN -1 ELSE capacidade END AS capacidade,
                          CASE WHEN id_local % 3 = 0 THEN 'RJX' ELSE estado END AS estado,
                          CASE WHEN id_local % 4 <> 0 THEN contato END AS contato) FROM local""",
    "campanha_bad": """
        SELECT * REPLACE (CASE WHEN id_campanha % 6 = 0 THEN 'Toxoide' ELSE tipo_vacina END AS tipo_vacina) FROM campanha""",
    "vacinacao_bad": f"""
        SELECT * REPLACE (CASE WHEN id_vacinacao % 97 = 0 THEN 0 ELSE contagem END AS contagem,
                          CASE WHEN id_vacinacao % 101 = 0 THEN id_vacina + {UNKNOWN} ELSE id_vacina END AS id_vacina,
                          CASE WHEN id_vacinacao % 103 = 0 THEN id_local + {UNKNOWN} ELSE id_local END AS id_local,
                          CASE WHEN id_vacinacao % 107 = 0 THEN id_campanha + 100 ELSE id_campanha END AS id_campanha)
        FROM vacinacao_all""",
    "agendamento_bad": f"""
        SELECT * REPLACE (CASE WHEN id_agendamento % 101 = 0 THEN id_vacina + {UNKNOWN} ELSE id_vacina END AS id_vacina,
                          CASE WHEN id_agendamento % 103 = 0 THEN id_local + {UNKNOWN} ELSE id_local END AS id_local)
        FROM agendamento_all""",
})
