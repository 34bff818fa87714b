"""Registered change-operator queries (C1–C21, K7) and their SQL oracles.

Each query runs one batch of derived requests (``imunis.sources.requests``)
through its operator over the whole tables and returns either the decisions
or the table the batch produced. The SQL judges the same requests with
correlated EXISTS probes and window functions over the whole batch — the
row-at-a-time rules written as set SQL, independently of the DataFrame code.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from ..operators import changes as ch
from ..operators.dose_changes import apply_vacinacao_changes
from .catalog import AS_OF, AS_OF_SQL, query, role_counts_sql, role_sql, user_list_sql

STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
PRECEDING = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _miss_text(*cols):
    return " OR ".join(f"{c} IS NULL OR {c} = ''" for c in cols)


def _miss_int(*cols):
    return " OR ".join(f"{c} IS NULL OR {c} = 0" for c in cols)


def _long(**cols):
    return " OR ".join(f"coalesce(length({c}) > {n}, false)" for c, n in cols.items()) or "false"


def _decisions_sql(src: str, id_sql: str | None = None) -> str:
    nid = "CAST(NULL AS BIGINT)" if id_sql is None else (
        f"CASE WHEN reason IS NULL THEN cast(({id_sql}) + sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) "
        f"OVER (ORDER BY req_seq {RUNNING}) AS bigint) END")
    return (f"SELECT cast(req_seq AS bigint) AS req_seq, reason IS NULL OR reason = 'no_match' AS accepted, reason, "
            f"{nid} AS new_id FROM {src}")


class _State(Mapping):
    """The ten tables of a fixture set, built only when an operator asks."""

    def __init__(self, t, swap):
        self.t, self.swap = t, swap

    def __getitem__(self, name):
        v = self.swap.get(name, name)
        return self.t[v] if isinstance(v, str) else v

    def __iter__(self):
        from ..sources.schemas import TABLES
        return iter(TABLES)

    def __len__(self):
        return 10


def _state(t, **swap):
    return _State(t, swap)


def _last_sql(src: str, key: str) -> str:
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY req_seq DESC) AS rn_last "
            f"FROM {src} WHERE reason IS NULL) z WHERE rn_last = 1)")


def _apply_sql(table: str, key: str, cols: list[str], all_cols: list[str], last: str) -> str:
    sel = ", ".join(f"CASE WHEN u.{key} IS NOT NULL THEN u.{c} ELSE t.{c} END AS {c}" if c in cols else f"t.{c}"
                    for c in all_cols)
    return f"SELECT {sel} FROM {table} t LEFT JOIN {last} u ON t.{key} = u.{key}"


def _first_sql(key: str) -> str:
    """reason for deletes: no_match for all but the first valid request per key."""
    return (f"CASE WHEN pre IS NULL AND coalesce(sum(CASE WHEN pre IS NULL THEN 1 ELSE 0 END) OVER "
            f"(PARTITION BY {key} ORDER BY req_seq {PRECEDING}), 0) > 0 THEN 'no_match' ELSE pre END")


VACINA_COLS = ["id_vacina", "nome", "doenca_alvo", "codigo_lote", "data_chegada", "data_validade", "qtd_doses"]
CAMPANHA_COLS = ["id_campanha", "nome", "doenca_alvo", "tipo_vacina", "data_inicio", "data_fim", "publico_alvo"]
LOCAL_COLS = ["id_local", "nome", "rua", "bairro", "numero", "cidade", "estado", "contato", "capacidade"]
PARENTE_COLS = ["id_parentesco", "cpf_responsavel", "cpf_parente"]
AGEND_COLS = ["id_agendamento", "data_agendamento", "id_vacina", "id_local", "cpf"]


# ====================================================================== vacinacao

_VI = {
    "vi_r": f"""SELECT req_seq, contagem, data_aplicacao, id_vacina, {STRIP.format(c='cpf')} AS cpf, id_local,
                     id_campanha FROM vacinacao_request""",
    "vi_j": f"""
        SELECT r.*, v.qtd_doses AS stock,
               ({_miss_text('r.cpf')} OR {_miss_int('r.id_vacina', 'r.id_local', 'r.id_campanha')}) AS c_miss,
               coalesce(r.contagem < 1, false) AS c_oor, {_long(**{'r.cpf': 20})} AS c_long,
               (r.contagem IS NULL OR r.data_aplicacao IS NULL) AS c_null,
               NOT EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf) AS c_cit,
               NOT (EXISTS (SELECT 1 FROM local l WHERE l.id_local = r.id_local)
                    AND EXISTS (SELECT 1 FROM campanha k WHERE k.id_campanha = r.id_campanha)) AS c_fk
        FROM vi_r r LEFT JOIN vacina v ON r.id_vacina = v.id_vacina""",
    "vi_u": f"""
        SELECT *, coalesce(sum(CASE WHEN NOT (c_miss OR c_oor OR c_long OR c_null OR c_cit OR c_fk) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY id_vacina ORDER BY req_seq {PRECEDING}), 0) AS used_before
        FROM vi_j""",
    "vi_d": """
        SELECT *, CASE WHEN c_miss THEN 'missing_field' WHEN c_oor THEN 'out_of_range' WHEN c_cit THEN 'not_citizen'
                       WHEN c_long THEN 'too_long' WHEN c_null THEN 'not_null'
                       WHEN stock IS NULL OR used_before >= stock THEN 'no_stock'
                       WHEN c_fk THEN 'fk_violation' END AS reason
        FROM vi_u""",
}


def _stock_sql(delta_src: str) -> str:
    sel = ", ".join("cast(v.qtd_doses + coalesce(x.s, 0) AS integer) AS qtd_doses" if c == "qtd_doses" else f"v.{c}"
                    for c in VACINA_COLS)
    return (f"SELECT {sel} FROM vacina v LEFT JOIN (SELECT id_vacina, sum(d) AS s FROM ({delta_src}) dd "
            f"GROUP BY id_vacina) x ON v.id_vacina = x.id_vacina")


@query("vacinacao_insert", (_VI, _decisions_sql("vi_d", "SELECT coalesce(max(id_vacinacao), 0) FROM vacinacao")))
def vacinacao_insert(t):
    """C19 + W1: the dose requests, stock counted in arrival order."""
    _, dec = ch.apply_vacinacao_insert(_state(t), t["vacinacao_request"])
    return dec


@query("vacinacao_insert_stock", (_VI, _stock_sql("SELECT id_vacina, -1 AS d FROM vi_d WHERE reason IS NULL")))
def vacinacao_insert_stock(t):
    """Lot stock after the batch (opening stock minus accepted doses)."""
    new, _ = ch.apply_vacinacao_insert(_state(t), t["vacinacao_request"])
    return new["vacina"]


def _lot_order_sql(src: str) -> str:
    """(req_seq, short) of the requests that reach the stock check: rounds of takes and returns until one changes nothing."""
    rows = "SELECT req_seq, id_vacinacao, id_vacina, old_vac, stock, NOT c_fk AS valid"
    return f"""
        WITH RECURSIVE rounds AS (
          {rows}, NOT c_fk AS acc, false AS short, true AS changed, 0 AS n FROM {src} WHERE pre IS NULL
          UNION ALL
          SELECT req_seq, id_vacinacao, id_vacina, old_vac, stock, valid, valid AND NOT now_short, now_short,
                 bool_or((valid AND NOT now_short) <> acc) OVER (), n + 1
          FROM (
            SELECT req_seq, any_value(id_vacinacao) AS id_vacinacao, any_value(id_vacina) AS id_vacina, any_value(old_vac) AS old_vac,
                   any_value(stock) AS stock, any_value(valid) AS valid, any_value(acc) AS acc, any_value(n) AS n,
                   coalesce(bool_or(e.asks AND (stock IS NULL OR stock < 0 OR stock + run - e.d - least(0, coalesce(stock + low, 0)) < 1)), false)
                   AS now_short
            FROM (
              SELECT *, min(run) OVER (PARTITION BY e.lot ORDER BY req_seq {PRECEDING}) AS low
              FROM (
                SELECT *, sum(e.d) OVER (PARTITION BY e.lot ORDER BY req_seq {RUNNING}) AS run
                FROM (
                  SELECT *, unnest(CASE WHEN id_vacina IS NOT DISTINCT FROM lot_now THEN [{{'lot': NULL, 'd': 0, 'asks': false}}]
                                        WHEN acc THEN [{{'lot': id_vacina, 'd': -1, 'asks': true}}, {{'lot': lot_now, 'd': 1, 'asks': false}}]
                                        ELSE [{{'lot': id_vacina, 'd': CASE WHEN valid THEN -1 ELSE 0 END, 'asks': true}}] END) AS e
                  FROM (
                    SELECT *, coalesce(last_value(CASE WHEN acc THEN id_vacina END IGNORE NULLS) OVER
                                       (PARTITION BY id_vacinacao ORDER BY req_seq {PRECEDING}), old_vac) AS lot_now
                    FROM rounds WHERE changed) a) b) c) d
            GROUP BY req_seq) x)
        SELECT req_seq, short FROM (SELECT *, max(n) OVER () AS last_n FROM rounds) z WHERE n = last_n"""


_VU = {
    "vu_r": f"""SELECT req_seq, id_vacinacao, contagem, data_aplicacao, id_vacina, {STRIP.format(c='cpf')} AS cpf,
                     id_local, id_campanha FROM vacinacao_update_req""",
    "vu_j": f"""
        SELECT r.*, o.id_vacina AS old_vac, o.id_vacinacao IS NOT NULL AS found, v.qtd_doses AS stock,
               ({_miss_text('r.cpf')}) AS c_miss, coalesce(r.contagem < 1, false) AS c_oor,
               {_long(**{'r.cpf': 20})} AS c_long, (r.contagem IS NULL OR r.data_aplicacao IS NULL) AS c_null,
               NOT EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf) AS c_cit,
               NOT (EXISTS (SELECT 1 FROM local l WHERE l.id_local = r.id_local)
                    AND EXISTS (SELECT 1 FROM campanha k WHERE k.id_campanha = r.id_campanha)
                    AND v.id_vacina IS NOT NULL) AS c_fk
        FROM vu_r r LEFT JOIN vacinacao o ON r.id_vacinacao = o.id_vacinacao
        LEFT JOIN vacina v ON r.id_vacina = v.id_vacina""",
    "vu_p": """
        SELECT *, CASE WHEN c_miss THEN 'missing_field' WHEN c_oor THEN 'out_of_range' WHEN c_cit THEN 'not_citizen'
                       WHEN NOT found THEN 'no_match' WHEN c_long THEN 'too_long' WHEN c_null THEN 'not_null' END AS pre
        FROM vu_j""",
    "vu_o": _lot_order_sql("vu_p"),
    "vu_d": """
        SELECT p.*, CASE WHEN pre IS NOT NULL THEN pre WHEN short THEN 'no_stock' WHEN c_fk THEN 'fk_violation' END AS reason
        FROM vu_p p LEFT JOIN vu_o o ON p.req_seq = o.req_seq""",
}
_VU["vu_last"] = f"SELECT * FROM {_last_sql('vu_d', 'id_vacinacao')} l"


@query("vacinacao_update", (_VU, _decisions_sql("vu_d")))
def vacinacao_update(t):
    """C20 decisions."""
    _, dec = ch.apply_vacinacao_update(_state(t), t["vacinacao_update_req"])
    return dec


@query("vacinacao_update_stock", (_VU, _stock_sql(
    "SELECT old_vac AS id_vacina, 1 AS d FROM vu_last WHERE id_vacina <> old_vac "
    "UNION ALL SELECT id_vacina, -1 FROM vu_last WHERE id_vacina <> old_vac")))
def vacinacao_update_stock(t):
    """C20 + W2: lot stock after the lot changes."""
    new, _ = ch.apply_vacinacao_update(_state(t), t["vacinacao_update_req"])
    return new["vacina"]


_VD = {
    "vd_j": """SELECT r.req_seq, r.id_vacinacao,
                      CASE WHEN NOT EXISTS (SELECT 1 FROM vacinacao o WHERE o.id_vacinacao = r.id_vacinacao)
                           THEN 'no_match' END AS pre
               FROM vacinacao_delete_req r""",
    "vd_d": f"SELECT *, {_first_sql('id_vacinacao')} AS reason FROM vd_j",
}


@query("vacinacao_delete", (_VD, _decisions_sql("vd_d")))
def vacinacao_delete(t):
    """C21 decisions."""
    _, dec = ch.apply_vacinacao_delete(_state(t), t["vacinacao_delete_req"])
    return dec


@query("vacinacao_delete_stock", (_VD, _stock_sql(
    "SELECT id_vacina, 1 AS d FROM vacinacao WHERE id_vacinacao IN (SELECT id_vacinacao FROM vd_d "
    "WHERE reason IS NULL)")))
def vacinacao_delete_stock(t):
    """One dose back per row really deleted."""
    new, _ = ch.apply_vacinacao_delete(_state(t), t["vacinacao_delete_req"])
    return new["vacina"]


# ====================================================================== vacina

def _vacina_reason(no_match: bool) -> str:
    nm = "WHEN NOT EXISTS (SELECT 1 FROM vacina t WHERE t.id_vacina = r.id_vacina) THEN 'no_match'" if no_match else ""
    return f"""CASE WHEN {_miss_text('nome', 'doenca_alvo', 'codigo_lote')} OR data_chegada IS NULL
                         OR data_validade IS NULL OR try_cast(codigo_lote AS bigint) = 0 THEN 'missing_field'
                    WHEN coalesce(qtd_doses < 0, false) OR NOT regexp_full_match(codigo_lote, '[0-9]+') THEN 'out_of_range'
                    WHEN data_validade <= data_chegada THEN 'bad_dates' {nm}
                    WHEN {_long(nome=100, doenca_alvo=100, codigo_lote=100)} THEN 'too_long'
                    WHEN nome IS NULL OR doenca_alvo IS NULL OR codigo_lote IS NULL OR data_chegada IS NULL
                         OR data_validade IS NULL OR qtd_doses IS NULL THEN 'not_null' END"""


_VAC_I = {"vac_i": f"SELECT *, {_vacina_reason(False)} AS reason FROM vacina_insert_req r"}


@query("vacina_insert", (_VAC_I, _decisions_sql("vac_i", "SELECT coalesce(max(id_vacina), 0) FROM vacina")))
def vacina_insert(t):
    """C4: field checks, expiry after arrival, dense new ids."""
    _, dec = ch.apply_vacina_insert(_state(t), t["vacina_insert_req"])
    return dec


_VAC_U = {"vac_u": f"SELECT *, {_vacina_reason(True)} AS reason FROM vacina_update_req r"}


@query("vacina_update", (_VAC_U, _decisions_sql("vac_u")))
def vacina_update(t):
    """C5 decisions."""
    _, dec = ch.apply_vacina_update(_state(t), t["vacina_update_req"])
    return dec


@query("vacina_update_state", (_VAC_U, _apply_sql("vacina", "id_vacina", VACINA_COLS[1:], VACINA_COLS,
                                                   _last_sql("vac_u", "id_vacina"))))
def vacina_update_state(t):
    """The lot table after the batch (last accepted update per lot)."""
    new, _ = ch.apply_vacina_update(_state(t), t["vacina_update_req"])
    return new["vacina"]


_VAC_D = {
    "vac_dj": """SELECT r.req_seq, r.id_vacina,
        CASE WHEN NOT EXISTS (SELECT 1 FROM vacina t WHERE t.id_vacina = r.id_vacina) THEN 'no_match'
             WHEN EXISTS (SELECT 1 FROM vacinacao d WHERE d.id_vacina = r.id_vacina) THEN 'in_use'
             WHEN EXISTS (SELECT 1 FROM agendamento a WHERE a.id_vacina = r.id_vacina) THEN 'fk_violation' END AS pre
        FROM vacina_delete_req r""",
    "vac_d": f"SELECT *, {_first_sql('id_vacina')} AS reason FROM vac_dj",
}


@query("vacina_delete", (_VAC_D, _decisions_sql("vac_d")))
def vacina_delete(t):
    """Lots in use, lots only booked, spare lots, and lots deleted before."""
    _, dec = ch.apply_vacina_delete(_state(t), t["vacina_delete_req"])
    return dec


# ====================================================================== campanha

def _campanha_reason(no_match: bool) -> str:
    nm = ("WHEN NOT EXISTS (SELECT 1 FROM campanha t WHERE t.id_campanha = r.id_campanha) THEN 'no_match'"
          if no_match else "")
    return f"""CASE WHEN {_miss_text('nome', 'doenca_alvo', 'publico_alvo')} OR data_inicio IS NULL
                         THEN 'missing_field'
                    WHEN data_fim IS NOT NULL AND data_fim < data_inicio THEN 'bad_dates' {nm}
                    WHEN {_long(nome=100, doenca_alvo=100, tipo_vacina=30, publico_alvo=100)} THEN 'too_long'
                    WHEN nome IS NULL OR doenca_alvo IS NULL OR tipo_vacina IS NULL OR data_inicio IS NULL
                         OR publico_alvo IS NULL THEN 'not_null' END"""


_CAMP_I = {"camp_i": f"SELECT *, {_campanha_reason(False)} AS reason FROM campanha_insert_req r"}


@query("campanha_insert", (_CAMP_I, _decisions_sql("camp_i", "SELECT coalesce(max(id_campanha), 0) FROM campanha")))
def campanha_insert(t):
    """C7."""
    _, dec = ch.apply_campanha_insert(_state(t), t["campanha_insert_req"])
    return dec


_CAMP_U = {"camp_u": f"SELECT *, {_campanha_reason(True)} AS reason FROM campanha_update_req r"}


@query("campanha_update", (_CAMP_U, _apply_sql("campanha", "id_campanha", CAMPANHA_COLS[1:], CAMPANHA_COLS,
                                                _last_sql("camp_u", "id_campanha"))))
def campanha_update(t):
    """Campaign table after the batch; several updates of one campaign,
    the last accepted wins; the end date may become NULL."""
    new, _ = ch.apply_campanha_update(_state(t), t["campanha_update_req"])
    return new["campanha"]


_CAMP_D = {
    "camp_dj": """SELECT r.req_seq, r.id_campanha,
        CASE WHEN NOT EXISTS (SELECT 1 FROM campanha t WHERE t.id_campanha = r.id_campanha) THEN 'no_match'
             WHEN EXISTS (SELECT 1 FROM vacinacao d WHERE d.id_campanha = r.id_campanha) THEN 'in_use' END AS pre
        FROM campanha_delete_req r""",
    "camp_d": f"SELECT *, {_first_sql('id_campanha')} AS reason FROM camp_dj",
}


@query("campanha_delete", (_CAMP_D, _decisions_sql("camp_d")))
def campanha_delete(t):
    """C9."""
    _, dec = ch.apply_campanha_delete(_state(t), t["campanha_delete_req"])
    return dec


# ====================================================================== local

def _local_reason(no_match: bool, table: str = "local") -> str:
    nm = (f"WHEN NOT EXISTS (SELECT 1 FROM {table} t WHERE t.id_local = r.id_local) THEN 'no_match'"
          if no_match else "")
    return f"""CASE WHEN {_miss_text('nome', 'rua', 'bairro', 'cidade', 'estado', 'contato')} OR {_miss_int('numero')}
                         THEN 'missing_field'
                    WHEN coalesce(numero < 1, false) OR coalesce(length(estado) > 2, false) THEN 'out_of_range' {nm}
                    WHEN {_long(nome=100, rua=100, bairro=100, cidade=100, estado=50, contato=100)} THEN 'too_long'
                    WHEN nome IS NULL OR rua IS NULL OR bairro IS NULL OR numero IS NULL OR cidade IS NULL
                         OR estado IS NULL OR contato IS NULL THEN 'not_null' END"""


_LOC_CAP = "CASE WHEN capacidade > 0 THEN capacidade END"
_LOC = {
    "loc_i": f"SELECT *, {_local_reason(False)} AS reason FROM local_insert_req r",
    "loc_i2": f"""SELECT cast((SELECT coalesce(max(id_local), 0) FROM local)
                              + sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY req_seq {RUNNING})
                              AS bigint) AS id_local, nome, rua, bairro, numero, cidade, estado, contato,
                         cast({_LOC_CAP} AS integer) AS capacidade, reason
                  FROM loc_i""",
    "local1": f"SELECT {', '.join(LOCAL_COLS)} FROM local UNION ALL "
              f"SELECT {', '.join(LOCAL_COLS)} FROM loc_i2 WHERE reason IS NULL",
    "loc_u": f"""SELECT req_seq, id_local, nome, rua, bairro, numero, cidade, estado, contato,
                        cast({_LOC_CAP} AS integer) AS capacidade, {_local_reason(True, 'local1')} AS reason
                 FROM local_update_req r""",
}


@query("local_upsert", (_LOC, _apply_sql("local1", "id_local", LOCAL_COLS[1:], LOCAL_COLS,
                                         _last_sql("loc_u", "id_local"))))
def local_upsert(t):
    """C10 then C11: an insert batch, then an update batch on its result;
    non-positive capacity is stored as NULL (P8)."""
    new, _ = ch.apply_local_insert(_state(t), t["local_insert_req"])
    new, _ = ch.apply_local_update(_state(t, local=new["local"]), t["local_update_req"])
    return new["local"]


_LOC_D = {
    "loc_dj": """SELECT r.req_seq, r.id_local,
        CASE WHEN NOT EXISTS (SELECT 1 FROM local t WHERE t.id_local = r.id_local) THEN 'no_match'
             WHEN EXISTS (SELECT 1 FROM vacinacao d WHERE d.id_local = r.id_local) THEN 'in_use'
             WHEN EXISTS (SELECT 1 FROM agendamento a WHERE a.id_local = r.id_local) THEN 'in_use' END AS pre
        FROM local_delete_req r""",
    "loc_d": f"SELECT *, {_first_sql('id_local')} AS reason FROM loc_dj",
}


@query("local_delete", (_LOC_D, _decisions_sql("loc_d")))
def local_delete(t):
    """C12."""
    _, dec = ch.apply_local_delete(_state(t), t["local_delete_req"])
    return dec


# ====================================================================== parente

_PAR_I = {
    "par_j": f"""
        SELECT r.*, ({_miss_text('cpf_responsavel', 'cpf_parente')}) AS c_miss,
               ({_long(cpf_responsavel=20, cpf_parente=20)}) AS c_long,
               coalesce(cpf_responsavel = cpf_parente, false) AS c_self,
               NOT (EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf_responsavel)
                    AND EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf_parente)) AS c_nc,
               EXISTS (SELECT 1 FROM parente p WHERE p.cpf_responsavel = r.cpf_responsavel
                       AND p.cpf_parente = r.cpf_parente) AS c_dup_t
        FROM parente_insert_req r""",
    "par_u": f"""
        SELECT *, coalesce(sum(CASE WHEN NOT (c_miss OR c_long OR c_self OR c_nc OR c_dup_t) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY cpf_responsavel, cpf_parente ORDER BY req_seq {PRECEDING}), 0) AS earlier
        FROM par_j""",
    "par_d": """
        SELECT *, CASE WHEN c_miss THEN 'missing_field' WHEN c_self THEN 'self_link'
                       WHEN c_dup_t OR earlier > 0 THEN 'duplicate' WHEN c_long THEN 'too_long'
                       WHEN c_nc THEN 'fk_violation' END AS reason
        FROM par_u""",
}


@query("parente_insert", (_PAR_I, _decisions_sql("par_d", "SELECT coalesce(max(id_parentesco), 0) FROM parente")))
def parente_insert(t):
    """C13 + W3: an ordered pair is linked once; the reverse is allowed."""
    _, dec = ch.apply_parente_insert(_state(t), t["parente_insert_req"])
    return dec


_PAR_U = {
    "paru_d": f"""
        SELECT r.*, CASE WHEN {_miss_text('cpf_responsavel', 'cpf_parente')} THEN 'missing_field'
            WHEN cpf_responsavel = cpf_parente THEN 'self_link'
            WHEN NOT EXISTS (SELECT 1 FROM parente p WHERE p.id_parentesco = r.id_parentesco) THEN 'no_match'
            WHEN {_long(cpf_responsavel=20, cpf_parente=20)} THEN 'too_long'
            WHEN NOT (EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf_responsavel)
                      AND EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf_parente)) THEN 'fk_violation' END
            AS reason
        FROM parente_update_req r""",
}


@query("parente_update", (_PAR_U, _apply_sql("parente", "id_parentesco", PARENTE_COLS[1:], PARENTE_COLS,
                                              _last_sql("paru_d", "id_parentesco"))))
def parente_update(t):
    """C14: link table after the batch (no duplicate check on update)."""
    new, _ = ch.apply_parente_update(_state(t), t["parente_update_req"])
    return new["parente"]


_PAR_D = {
    "pard_j": """SELECT r.req_seq, r.id_parentesco,
        CASE WHEN NOT EXISTS (SELECT 1 FROM parente t WHERE t.id_parentesco = r.id_parentesco) THEN 'no_match' END
        AS pre FROM parente_delete_req r""",
    "pard_d": f"SELECT *, {_first_sql('id_parentesco')} AS reason FROM pard_j",
}


@query("parente_delete", (_PAR_D, _decisions_sql("pard_d")))
def parente_delete(t):
    """C15."""
    _, dec = ch.apply_parente_delete(_state(t), t["parente_delete_req"])
    return dec


# ====================================================================== agendamento

_AG_J = f"""
    SELECT r.*, ({_miss_text('typed')} OR {_miss_int('id_campanha', 'id_vacina', 'id_local')}
                 OR data_agendamento IS NULL) AS c_miss,
           {_long(cpf=20)} AS c_long,
           NOT (EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf)
                AND EXISTS (SELECT 1 FROM vacina v WHERE v.id_vacina = r.id_vacina)
                AND EXISTS (SELECT 1 FROM local l WHERE l.id_local = r.id_local)) AS c_fk,
           NOT (EXISTS (SELECT 1 FROM vacina v WHERE v.id_vacina = r.id_vacina AND v.data_validade >= {AS_OF_SQL})
                AND EXISTS (SELECT 1 FROM campanha k WHERE k.id_campanha = r.id_campanha
                            AND (k.data_fim IS NULL OR k.data_fim >= {AS_OF_SQL}) AND k.data_inicio <= {AS_OF_SQL})
                AND EXISTS (SELECT 1 FROM local l WHERE l.id_local = r.id_local)) AS c_noff,
           EXISTS (SELECT 1 FROM agendamento a WHERE a.cpf = r.cpf AND a.id_vacina = r.id_vacina
                   AND a.data_agendamento = r.data_agendamento) AS c_dup_t
    FROM (SELECT req_seq, cpf AS typed, {STRIP.format(c='cpf')} AS cpf, id_campanha, id_vacina, id_local, data_agendamento
          FROM agendamento_insert_req) r"""
_AG_MAX = "SELECT coalesce(max(id_agendamento), 0) FROM agendamento"

_AG_I = {
    "ag_j": _AG_J,
    "ag_d": """SELECT *, CASE WHEN c_miss THEN 'missing_field' WHEN c_long THEN 'too_long'
                              WHEN c_fk THEN 'fk_violation' END AS reason FROM ag_j""",
}


@query("agendamento_insert", (_AG_I, _decisions_sql("ag_d", _AG_MAX)))
def agendamento_insert(t):
    """Only field and key checks, as the reference does."""
    _, dec = ch.apply_agendamento_insert(_state(t), t["agendamento_insert_req"])
    return dec


_AG_N = {
    "ag_j": _AG_J,
    "ag_n": """SELECT *, CASE WHEN c_miss THEN 'missing_field' WHEN c_noff THEN 'not_offered'
                              WHEN c_long THEN 'too_long' WHEN c_fk THEN 'fk_violation' END AS reason FROM ag_j""",
}


@query("agendamento_not_offered", (_AG_N, _decisions_sql("ag_n", _AG_MAX)))
def agendamento_not_offered(t):
    """K7: C16 with option membership on (active campaign, unexpired lot,
    known site, as of 1998-06-01)."""
    _, dec = ch.apply_agendamento_insert(_state(t), t["agendamento_insert_req"], check_options=True, as_of=AS_OF)
    return dec


def _strict_order_sql(src: str) -> str:
    """(req_seq, dup, full): rounds of first-come keys and seats until one changes nothing."""
    return f"""
        WITH RECURSIVE rounds AS (
          SELECT s.req_seq, s.cpf, s.id_vacina, s.data_agendamento, s.id_local, c_dup_t, NOT (c_miss OR c_long OR c_fk) AS v0,
                 coalesce(b.booked, 0) AS booked, coalesce(l.capacidade, 0) AS cap,
                 NOT (c_miss OR c_long OR c_fk OR c_dup_t) AS acc, false AS dup, false AS is_full, true AS changed, 0 AS n
          FROM {src} s
          LEFT JOIN (SELECT id_local, data_agendamento, count(*) AS booked FROM agendamento
                     GROUP BY id_local, data_agendamento) b
                 ON s.id_local = b.id_local AND s.data_agendamento = b.data_agendamento
          LEFT JOIN local l ON s.id_local = l.id_local
          UNION ALL
          SELECT * EXCLUDE (now_dup, seats_before, acc, dup, is_full, changed, n), v0 AND NOT now_dup AND booked + seats_before < cap,
                 now_dup, booked + seats_before >= cap,
                 bool_or((v0 AND NOT now_dup AND booked + seats_before < cap) <> acc) OVER (), n + 1
          FROM (
            SELECT *, coalesce(sum(CASE WHEN v0 AND NOT now_dup THEN 1 ELSE 0 END)
                               OVER (PARTITION BY id_local, data_agendamento ORDER BY req_seq {PRECEDING}), 0) AS seats_before
            FROM (SELECT *, c_dup_t OR coalesce(bool_or(acc) OVER (PARTITION BY cpf, id_vacina, data_agendamento
                                                                    ORDER BY req_seq {PRECEDING}), false) AS now_dup
                  FROM rounds WHERE changed) a) b)
        SELECT req_seq, dup, is_full FROM (SELECT *, max(n) OVER () AS last_n FROM rounds) z WHERE n = last_n"""


_AG_S = {
    "ag_j": _AG_J,
    "ag_so": _strict_order_sql("ag_j"),
    "ag_sd": """SELECT j.*, CASE WHEN c_miss THEN 'missing_field' WHEN c_long THEN 'too_long'
                                 WHEN dup THEN 'duplicate' WHEN is_full THEN 'full'
                                 WHEN c_fk THEN 'fk_violation' END AS reason
                FROM ag_j j JOIN ag_so o ON j.req_seq = o.req_seq""",
}


@query("agendamento_insert_strict", (_AG_S, _decisions_sql("ag_sd", _AG_MAX)))
def agendamento_insert_strict(t):
    """C16 strict: plus duplicate (V6) and seats per site and day."""
    _, dec = ch.apply_agendamento_insert(_state(t), t["agendamento_insert_req"], strict=True)
    return dec


_AG_U = {
    "agu_d": f"""
        SELECT r.*, CASE WHEN {_miss_text('typed')} OR {_miss_int('id_campanha', 'id_vacina', 'id_local')}
                              OR data_agendamento IS NULL THEN 'missing_field'
            WHEN NOT EXISTS (SELECT 1 FROM agendamento a WHERE a.id_agendamento = r.id_agendamento) THEN 'no_match'
            WHEN {_long(cpf=20)} THEN 'too_long'
            WHEN NOT (EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf)
                      AND EXISTS (SELECT 1 FROM vacina v WHERE v.id_vacina = r.id_vacina)
                      AND EXISTS (SELECT 1 FROM local l WHERE l.id_local = r.id_local)) THEN 'fk_violation' END
            AS reason
        FROM (SELECT req_seq, id_agendamento, cpf AS typed, {STRIP.format(c='cpf')} AS cpf, id_campanha, id_vacina, id_local,
                     data_agendamento FROM agendamento_update_req) r""",
}


@query("agendamento_update", (_AG_U, _apply_sql("agendamento", "id_agendamento", AGEND_COLS[1:], AGEND_COLS,
                                                 _last_sql("agu_d", "id_agendamento"))))
def agendamento_update(t):
    """C17: appointment table after the batch."""
    new, _ = ch.apply_agendamento_update(_state(t), t["agendamento_update_req"])
    return new["agendamento"]


_AG_D = {
    "agd_j": """SELECT r.req_seq, r.id_agendamento,
        CASE WHEN NOT EXISTS (SELECT 1 FROM agendamento t WHERE t.id_agendamento = r.id_agendamento)
             THEN 'no_match' END AS pre FROM agendamento_delete_req r""",
    "agd_d": f"SELECT *, {_first_sql('id_agendamento')} AS reason FROM agd_j",
}


@query("agendamento_delete", (_AG_D, _decisions_sql("agd_d")))
def agendamento_delete(t):
    """C18."""
    _, dec = ch.apply_agendamento_delete(_state(t), t["agendamento_delete_req"])
    return dec


# ====================================================================== usuario

def _role_long(tipo: str) -> str:
    return f"""CASE WHEN {tipo} = 'Cidadão' THEN {_long(cpf=20, cartao_sus=100, rua=100, bairro=100, cidade=100,
                                                       estado=50)}
                    WHEN {tipo} = 'Administrador' THEN {_long(cpf=20, local_trabalho=100)}
                    WHEN {tipo} = 'Agente de Saúde' THEN {_long(cpf=20, email=100, posto_trabalho=100)}
                    ELSE false END"""


def _role_null(tipo: str) -> str:
    return f"""CASE WHEN {tipo} = 'Administrador' THEN local_trabalho IS NULL
                    WHEN {tipo} = 'Agente de Saúde' THEN email IS NULL OR posto_trabalho IS NULL ELSE false END"""


def _has_role(tipo: str) -> str:
    return f"""CASE WHEN {tipo} = 'Cidadão' THEN EXISTS (SELECT 1 FROM cidadao x WHERE x.cpf = r.cpf)
                    WHEN {tipo} = 'Administrador' THEN EXISTS (SELECT 1 FROM administrador x WHERE x.cpf = r.cpf)
                    WHEN {tipo} = 'Agente de Saúde' THEN EXISTS (SELECT 1 FROM agente_saude x WHERE x.cpf = r.cpf)
                    ELSE false END"""


_US_I = {
    "usi_r": f"""SELECT * REPLACE ({STRIP.format(c='cpf')} AS cpf) FROM usuario_insert_req""",
    "usi_j": f"""
        SELECT r.*, ({_miss_text('cpf', 'nome', 'telefone')}) AS c_miss,
               ({_long(cpf=20, nome=100, telefone=100)} OR {_role_long('tipo_usuario')}) AS c_long,
               coalesce({_role_null('tipo_usuario')}, false) AS c_null,
               (EXISTS (SELECT 1 FROM usuario u WHERE u.cpf = r.cpf) OR {_has_role('tipo_usuario')}) AS c_taken
        FROM usi_r r""",
    "usi_u": f"""
        SELECT *, coalesce(sum(CASE WHEN NOT (c_miss OR c_long OR c_null) AND NOT c_taken THEN 1 ELSE 0 END)
                  OVER (PARTITION BY cpf ORDER BY req_seq {PRECEDING}), 0) AS earlier
        FROM usi_j""",
    "usi_d": """SELECT *, CASE WHEN c_miss THEN 'missing_field' WHEN c_long THEN 'too_long'
                               WHEN c_null THEN 'not_null' WHEN c_taken OR earlier > 0 THEN 'duplicate' END AS reason
                FROM usi_u""",
}


@query("usuario_insert", (_US_I, _decisions_sql("usi_d")))
def usuario_insert(t):
    """A cpf is taken by the table or by an earlier request of the batch."""
    _, dec = ch.apply_usuario_insert(_state(t), t["usuario_insert_req"])
    return dec


_US_U = {
    "usu_j": f"""
        SELECT r.*, s.shown,
               (EXISTS (SELECT 1 FROM vacinacao d WHERE d.cpf = r.cpf)
                OR EXISTS (SELECT 1 FROM agendamento a WHERE a.cpf = r.cpf)
                OR EXISTS (SELECT 1 FROM parente p WHERE p.cpf_responsavel = r.cpf OR p.cpf_parente = r.cpf))
               AS cit_ref
        FROM usuario_update_req r LEFT JOIN (SELECT cpf, {role_sql('cpf')} AS shown FROM usuario) s ON r.cpf = s.cpf""",
    "usu_d": f"""
        SELECT *, CASE WHEN {STRIP.format(c='cpf_digitado')} IS DISTINCT FROM cpf THEN 'key_change'
                       WHEN shown IS NULL THEN 'no_match'
                       WHEN {_long(cpf=20, nome=100, telefone=100)} OR {_role_long('tipo_usuario')} THEN 'too_long'
                       WHEN nome IS NULL OR telefone IS NULL OR {_role_null('tipo_usuario')} THEN 'not_null'
                       WHEN tipo_usuario <> shown AND shown = 'Cidadão' AND cit_ref THEN 'fk_violation'
                       WHEN tipo_usuario <> shown AND {_has_role('tipo_usuario')} THEN 'duplicate' END AS reason
        FROM usu_j r""",
}


@query("usuario_update", (_US_U, _decisions_sql("usu_d")))
def usuario_update(t):
    """Key change, role moves that would duplicate a role row or orphan a
    referenced citizen."""
    _, dec = ch.apply_usuario_update(_state(t), t["usuario_update_req"])
    return dec


_US_D = {
    "usd_j": """SELECT r.req_seq, r.cpf,
        CASE WHEN NOT EXISTS (SELECT 1 FROM usuario t WHERE t.cpf = r.cpf) THEN 'no_match'
             WHEN EXISTS (SELECT 1 FROM vacinacao d WHERE d.cpf = r.cpf) THEN 'in_use'
             WHEN EXISTS (SELECT 1 FROM agendamento a WHERE a.cpf = r.cpf) THEN 'fk_violation'
             WHEN EXISTS (SELECT 1 FROM parente p WHERE p.cpf_responsavel = r.cpf) THEN 'fk_violation'
             WHEN EXISTS (SELECT 1 FROM parente p WHERE p.cpf_parente = r.cpf) THEN 'fk_violation' END AS pre
        FROM usuario_delete_req r""",
    "usd_d": f"SELECT *, {_first_sql('cpf')} AS reason FROM usd_j",
}


@query("usuario_delete", (_US_D, _decisions_sql("usd_d")))
def usuario_delete(t):
    """C3 with the cascade to the three role tables (K3)."""
    _, dec = ch.apply_usuario_delete(_state(t), t["usuario_delete_req"])
    return dec


# ---------------------------------------------------------------------- C1/C2 effects on the role tables

_US_I_ROLES = dict(_US_I)
_US_I_ROLES.update({
    "usi_ok": "SELECT * FROM usi_d WHERE reason IS NULL",
    "usi_users": "SELECT cpf FROM usuario UNION ALL SELECT cpf FROM usi_ok",
    "usi_cid": "SELECT cpf FROM cidadao UNION ALL SELECT cpf FROM usi_ok WHERE tipo_usuario = 'Cidadão'",
    "usi_adm": "SELECT cpf FROM administrador UNION ALL SELECT cpf FROM usi_ok WHERE tipo_usuario = 'Administrador'",
    "usi_age": "SELECT cpf FROM agente_saude UNION ALL SELECT cpf FROM usi_ok WHERE tipo_usuario = 'Agente de Saúde'",
})


@query("usuario_insert_roles", (_US_I_ROLES, role_counts_sql("usi_users", "usi_cid", "usi_adm", "usi_age")))
def usuario_insert_roles(t):
    """Users per shown role after the insert batch (user + one role row each)."""
    from ..operators import lists
    new, _ = ch.apply_usuario_insert(_state(t), t["usuario_insert_req"])
    return lists.role_counts({**{n: t[n] for n in ("cidadao", "administrador", "agente_saude", "usuario")}, **new})


def _moved(role: str, table: str) -> str:
    return f"""SELECT cpf FROM {table} x WHERE NOT EXISTS (SELECT 1 FROM usu_last l WHERE l.cpf = x.cpf
                   AND l.shown = '{role}' AND l.tipo_usuario <> '{role}')
               UNION ALL SELECT cpf FROM usu_last WHERE tipo_usuario = '{role}' AND shown <> '{role}'"""


_US_U_ROLES = dict(_US_U)
_US_U_ROLES.update({
    "usu_last": f"SELECT * FROM {_last_sql('usu_d', 'cpf')} l",
    "usu_cid": _moved("Cidadão", "cidadao"),
    "usu_adm": _moved("Administrador", "administrador"),
    "usu_age": _moved("Agente de Saúde", "agente_saude"),
})


@query("usuario_update_roles", (_US_U_ROLES, role_counts_sql("usuario", "usu_cid", "usu_adm", "usu_age")))
def usuario_update_roles(t):
    """Users per shown role after the role moves of the update batch."""
    from ..operators import lists
    new, _ = ch.apply_usuario_update(_state(t), t["usuario_update_req"])
    return lists.role_counts(new)


_ROLE_COLS = {"cidadao": ("Cidadão", ["cartao_sus", "rua", "bairro", "numero", "cidade", "estado"]),
              "administrador": ("Administrador", ["local_trabalho"]),
              "agente_saude": ("Agente de Saúde", ["email", "posto_trabalho"])}


def _role_table_after(table: str) -> str:
    role, cols = _ROLE_COLS[table]
    same = f"l.cpf IS NOT NULL AND l.shown = '{role}' AND l.tipo_usuario = '{role}'"
    kept = ", ".join(f"CASE WHEN {same} THEN l.{c} ELSE x.{c} END AS {c}" for c in cols)
    return f"""SELECT x.cpf, {kept} FROM {table} x LEFT JOIN usu_last l ON x.cpf = l.cpf
               WHERE NOT (l.cpf IS NOT NULL AND l.shown = '{role}' AND l.tipo_usuario <> '{role}')
               UNION ALL
               SELECT cpf, {', '.join(cols)} FROM usu_last WHERE tipo_usuario = '{role}' AND shown <> '{role}'"""


_US_U_STATE = dict(_US_U)
_US_U_STATE.update({
    "usu_last": f"SELECT * FROM {_last_sql('usu_d', 'cpf')} l",
    "usu_users": """SELECT u.cpf, CASE WHEN l.cpf IS NOT NULL THEN l.nome ELSE u.nome END AS nome,
                           CASE WHEN l.cpf IS NOT NULL THEN l.telefone ELSE u.telefone END AS telefone
                    FROM usuario u LEFT JOIN usu_last l ON u.cpf = l.cpf""",
    "usu_cid2": _role_table_after("cidadao"),
    "usu_adm2": _role_table_after("administrador"),
    "usu_age2": _role_table_after("agente_saude"),
})


@query("usuario_update_state", (_US_U_STATE, user_list_sql("usu_users", "usu_cid2", "usu_adm2", "usu_age2")))
def usuario_update_state(t):
    """The full user list (J2) after the update batch."""
    from ..operators import lists
    new, _ = ch.apply_usuario_update(_state(t), t["usuario_update_req"])
    return lists.usuarios_completo(new, ordered=False)


_US_D_STATE = dict(_US_D)
_US_D_STATE.update({
    "usd_gone": "SELECT cpf FROM usd_d WHERE reason IS NULL",
    "usd_users": "SELECT * FROM usuario x WHERE NOT EXISTS (SELECT 1 FROM usd_gone g WHERE g.cpf = x.cpf)",
    "usd_cid": "SELECT * FROM cidadao x WHERE NOT EXISTS (SELECT 1 FROM usd_gone g WHERE g.cpf = x.cpf)",
    "usd_adm": "SELECT * FROM administrador x WHERE NOT EXISTS (SELECT 1 FROM usd_gone g WHERE g.cpf = x.cpf)",
    "usd_age": "SELECT * FROM agente_saude x WHERE NOT EXISTS (SELECT 1 FROM usd_gone g WHERE g.cpf = x.cpf)",
})


@query("usuario_delete_state", (_US_D_STATE, user_list_sql("usd_users", "usd_cid", "usd_adm", "usd_age")))
def usuario_delete_state(t):
    """C3 + K3: the user list after the delete batch (role rows cascade)."""
    from ..operators import lists
    new, _ = ch.apply_usuario_delete(_state(t), t["usuario_delete_req"])
    return lists.usuarios_completo(new, ordered=False)


_AG_I_STATE = dict(_AG_I)
_AG_I_STATE["ag_ids"] = f"""
    SELECT *, cast(({_AG_MAX}) + sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END)
                   OVER (ORDER BY req_seq {RUNNING}) AS bigint) AS new_id FROM ag_d"""


@query("agendamento_insert_state", (_AG_I_STATE, """
    SELECT id_agendamento, data_agendamento, id_vacina, id_local, cpf FROM agendamento
    UNION ALL
    SELECT new_id, data_agendamento, id_vacina, id_local, cpf FROM ag_ids WHERE reason IS NULL"""))
def agendamento_insert_state(t):
    """The appointment table after the batch, new rows with their ids."""
    new, _ = ch.apply_agendamento_insert(_state(t), t["agendamento_insert_req"])
    return new["agendamento"]


_PAR_I_STATE = dict(_PAR_I)
_PAR_I_STATE["par_ids"] = f"""
    SELECT *, cast((SELECT coalesce(max(id_parentesco), 0) FROM parente)
                   + sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY req_seq {RUNNING}) AS bigint)
              AS new_id FROM par_d"""


@query("parente_insert_state", (_PAR_I_STATE, """
    SELECT id_parentesco, cpf_responsavel, cpf_parente FROM parente
    UNION ALL
    SELECT new_id, cpf_responsavel, cpf_parente FROM par_ids WHERE reason IS NULL"""))
def parente_insert_state(t):
    """The link table after the batch."""
    new, _ = ch.apply_parente_insert(_state(t), t["parente_insert_req"])
    return new["parente"]


_VI_STATE = dict(_VI)
_VI_STATE["vi_ids"] = f"""
    SELECT *, cast((SELECT coalesce(max(id_vacinacao), 0) FROM vacinacao)
                   + sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY req_seq {RUNNING}) AS bigint)
              AS new_id FROM vi_d"""


@query("vacinacao_insert_state", (_VI_STATE, """
    SELECT id_vacinacao, contagem, data_aplicacao, id_vacina, cpf, id_local, id_campanha FROM vacinacao
    UNION ALL
    SELECT new_id, contagem, data_aplicacao, id_vacina, cpf, id_local, id_campanha FROM vi_ids
    WHERE reason IS NULL"""))
def vacinacao_insert_state(t):
    """The dose table after the batch (accepted doses appended with ids)."""
    new, _ = ch.apply_vacinacao_insert(_state(t), t["vacinacao_request"])
    return new["vacinacao"]


# ---------------------------------------------------------------------- tables after insert / delete batches

def _insert_state_sql(table: str, key: str, cols: list[str], judged: str, ctes: dict, cast: str = "bigint",
                      write: dict | None = None) -> tuple[dict, str]:
    out = dict(ctes)
    out[f"{judged}_ids"] = f"""
        SELECT *, cast((SELECT coalesce(max({key}), 0) FROM {table})
                       + sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY req_seq {RUNNING})
                       AS {cast}) AS new_id FROM {judged}"""
    sel = ", ".join("new_id" if c == key else (write or {}).get(c, c) for c in cols)
    return out, f"SELECT {', '.join(cols)} FROM {table} UNION ALL SELECT {sel} FROM {judged}_ids WHERE reason IS NULL"


def _delete_state_sql(table: str, key: str, judged: str, ctes: dict) -> tuple[dict, str]:
    return dict(ctes), (f"SELECT * FROM {table} t WHERE NOT EXISTS "
                        f"(SELECT 1 FROM {judged} d WHERE d.reason IS NULL AND d.{key} = t.{key})")


@query("vacina_insert_state", _insert_state_sql("vacina", "id_vacina", VACINA_COLS, "vac_i", _VAC_I))
def vacina_insert_state(t):
    """C4: the lot table after the batch."""
    new, _ = ch.apply_vacina_insert(_state(t), t["vacina_insert_req"])
    return new["vacina"]


@query("campanha_insert_state", _insert_state_sql("campanha", "id_campanha", CAMPANHA_COLS, "camp_i", _CAMP_I,
                                                  "integer"))
def campanha_insert_state(t):
    """The campaign table after the batch."""
    new, _ = ch.apply_campanha_insert(_state(t), t["campanha_insert_req"])
    return new["campanha"]


@query("vacina_delete_state", _delete_state_sql("vacina", "id_vacina", "vac_d", _VAC_D))
def vacina_delete_state(t):
    """The lot table after the batch."""
    new, _ = ch.apply_vacina_delete(_state(t), t["vacina_delete_req"])
    return new["vacina"]


@query("local_delete_state", _delete_state_sql("local", "id_local", "loc_d", _LOC_D))
def local_delete_state(t):
    """The site table after the batch."""
    new, _ = ch.apply_local_delete(_state(t), t["local_delete_req"])
    return new["local"]


@query("parente_delete_state", _delete_state_sql("parente", "id_parentesco", "pard_d", _PAR_D))
def parente_delete_state(t):
    """The link table after the batch."""
    new, _ = ch.apply_parente_delete(_state(t), t["parente_delete_req"])
    return new["parente"]


@query("agendamento_delete_state", _delete_state_sql("agendamento", "id_agendamento", "agd_d", _AG_D))
def agendamento_delete_state(t):
    """The appointment table after the cancellations."""
    new, _ = ch.apply_agendamento_delete(_state(t), t["agendamento_delete_req"])
    return new["agendamento"]


VACINACAO_ALL = ["id_vacinacao", "contagem", "data_aplicacao", "id_vacina", "cpf", "id_local", "id_campanha"]


@query("vacinacao_update_state", (_VU, _apply_sql("vacinacao", "id_vacinacao", VACINACAO_ALL[1:], VACINACAO_ALL,
                                                   _last_sql("vu_d", "id_vacinacao"))))
def vacinacao_update_state(t):
    """C20: the dose table after the batch (last accepted update per dose)."""
    new, _ = ch.apply_vacinacao_update(_state(t), t["vacinacao_update_req"])
    return new["vacinacao"]


@query("vacinacao_delete_state", _delete_state_sql("vacinacao", "id_vacinacao", "vd_d", _VD))
def vacinacao_delete_state(t):
    """The dose table after the batch."""
    new, _ = ch.apply_vacinacao_delete(_state(t), t["vacinacao_delete_req"])
    return new["vacinacao"]


@query("campanha_delete_state", _delete_state_sql("campanha", "id_campanha", "camp_d", _CAMP_D))
def campanha_delete_state(t):
    """The campaign table after the batch."""
    new, _ = ch.apply_campanha_delete(_state(t), t["campanha_delete_req"])
    return new["campanha"]


# ---------------------------------------------------------------------- decisions of C8, C10, C11, C14, C17

@query("campanha_update_decisions", (_CAMP_U, _decisions_sql("camp_u")))
def campanha_update_decisions(t):
    """C8 decisions."""
    return ch.apply_campanha_update(_state(t), t["campanha_update_req"])[1]


@query("local_insert", (_LOC, _decisions_sql("loc_i", "SELECT coalesce(max(id_local), 0) FROM local")))
def local_insert(t):
    """C10 decisions."""
    return ch.apply_local_insert(_state(t), t["local_insert_req"])[1]


_LOC_U0 = {"loc_u0": f"SELECT *, {_local_reason(True)} AS reason FROM local_update_req r"}


@query("local_update", (_LOC_U0, _decisions_sql("loc_u0")))
def local_update(t):
    """C11 decisions."""
    return ch.apply_local_update(_state(t), t["local_update_req"])[1]


@query("parente_update_decisions", (_PAR_U, _decisions_sql("paru_d")))
def parente_update_decisions(t):
    """C14 decisions."""
    return ch.apply_parente_update(_state(t), t["parente_update_req"])[1]


@query("agendamento_update_decisions", (_AG_U, _decisions_sql("agu_d")))
def agendamento_update_decisions(t):
    """C17 decisions."""
    return ch.apply_agendamento_update(_state(t), t["agendamento_update_req"])[1]


# ---------------------------------------------------------------------- K7: option membership on the other forms

_OFFERED = f"""(EXISTS (SELECT 1 FROM vacina w WHERE w.id_vacina = r.id_vacina AND w.data_validade >= {AS_OF_SQL})
                AND EXISTS (SELECT 1 FROM campanha k WHERE k.id_campanha = r.id_campanha AND k.data_inicio <= {AS_OF_SQL}
                            AND coalesce(k.data_fim, DATE '9999-12-31') >= {AS_OF_SQL})
                AND EXISTS (SELECT 1 FROM local s WHERE s.id_local = r.id_local))"""


def _not_offered(judged: str, cond: str) -> str:
    """The judged requests with ``not_offered`` right after ``missing_field``."""
    return (f"SELECT * REPLACE (CASE WHEN reason IS DISTINCT FROM 'missing_field' AND ({cond}) THEN 'not_offered' "
            f"ELSE reason END AS reason) FROM {judged} r")


_PAR_N = dict(_PAR_I)
_PAR_N.update({
    "par_nu": f"""
        SELECT *, coalesce(sum(CASE WHEN NOT (c_miss OR c_long OR c_self OR c_nc OR c_dup_t) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY cpf_responsavel, cpf_parente ORDER BY req_seq {PRECEDING}), 0) AS before
        FROM par_j""",
    "par_n": """SELECT *, CASE WHEN c_miss THEN 'missing_field' WHEN c_nc THEN 'not_offered' WHEN c_self THEN 'self_link'
                               WHEN c_dup_t OR before > 0 THEN 'duplicate' WHEN c_long THEN 'too_long' END AS reason
                FROM par_nu""",
})


@query("parente_insert_not_offered", (_PAR_N, _decisions_sql("par_n", "SELECT coalesce(max(id_parentesco), 0) FROM parente")))
def parente_insert_not_offered(t):
    """K7 on C13: both ends must be in the citizen list."""
    return ch.apply_parente_insert(_state(t), t["parente_insert_req"], check_options=True)[1]


_PAR_UN = dict(_PAR_U)
_PAR_UN["paru_n"] = _not_offered("paru_d", """NOT EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf_responsavel)
    OR NOT EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf_parente)""")


@query("parente_update_not_offered", (_PAR_UN, _decisions_sql("paru_n")))
def parente_update_not_offered(t):
    """K7 on C14."""
    return ch.apply_parente_update(_state(t), t["parente_update_req"], check_options=True)[1]


_AG_UN = dict(_AG_U)
_AG_UN["agu_n"] = _not_offered("agu_d", f"NOT {_OFFERED}")


@query("agendamento_update_not_offered", (_AG_UN, _decisions_sql("agu_n")))
def agendamento_update_not_offered(t):
    """K7 on C17."""
    return ch.apply_agendamento_update(_state(t), t["agendamento_update_req"], check_options=True, as_of=AS_OF)[1]


_VI_N = {
    "vi_r": _VI["vi_r"], "vi_j": _VI["vi_j"],
    "vi_nu": f"""
        SELECT r.*, NOT {_OFFERED} AS c_noff,
               coalesce(sum(CASE WHEN NOT (c_miss OR c_oor OR c_long OR c_null OR c_cit OR c_fk) AND {_OFFERED}
                                 THEN 1 ELSE 0 END) OVER (PARTITION BY id_vacina ORDER BY req_seq {PRECEDING}), 0) AS used_before
        FROM vi_j r""",
    "vi_n": """
        SELECT *, CASE WHEN c_miss THEN 'missing_field' WHEN c_noff THEN 'not_offered' WHEN c_oor THEN 'out_of_range'
                       WHEN c_cit THEN 'not_citizen' WHEN c_long THEN 'too_long' WHEN c_null THEN 'not_null'
                       WHEN stock IS NULL OR used_before >= stock THEN 'no_stock'
                       WHEN c_fk THEN 'fk_violation' END AS reason
        FROM vi_nu""",
}


@query("vacinacao_insert_not_offered", (_VI_N, _decisions_sql("vi_n", "SELECT coalesce(max(id_vacinacao), 0) FROM vacinacao")))
def vacinacao_insert_not_offered(t):
    """K7 on C19."""
    return ch.apply_vacinacao_insert(_state(t), t["vacinacao_request"], check_options=True, as_of=AS_OF)[1]


_VU_N = {
    "vu_r": _VU["vu_r"], "vu_j": _VU["vu_j"],
    "vu_np": f"""
        SELECT r.*, CASE WHEN c_miss THEN 'missing_field' WHEN NOT {_OFFERED} THEN 'not_offered' WHEN c_oor THEN 'out_of_range'
                         WHEN c_cit THEN 'not_citizen' WHEN NOT found THEN 'no_match' WHEN c_long THEN 'too_long'
                         WHEN c_null THEN 'not_null' END AS pre
        FROM vu_j r""",
    "vu_no": _lot_order_sql("vu_np"),
    "vu_n": """
        SELECT p.*, CASE WHEN pre IS NOT NULL THEN pre WHEN short THEN 'no_stock' WHEN c_fk THEN 'fk_violation' END AS reason
        FROM vu_np p LEFT JOIN vu_no o ON p.req_seq = o.req_seq""",
}


@query("vacinacao_update_not_offered", (_VU_N, _decisions_sql("vu_n")))
def vacinacao_update_not_offered(t):
    """K7 on C20."""
    return ch.apply_vacinacao_update(_state(t), t["vacinacao_update_req"], check_options=True, as_of=AS_OF)[1]


# ---------------------------------------------------------------------- batches whose requests depend on one another

def _over(ctes: dict, swap: dict) -> dict:
    """The same judgement over other tables."""
    out = {}
    for name, sql in ctes.items():
        for old, new in swap.items():
            sql = re.sub(rf"\b{old}\b", new, sql)
        out[name] = sql
    return out


_VU_O = _over(_VU, {"vacinacao_update_req": "vacinacao_chain_req", "vacina": "vacina_scarce"})


@query("vacinacao_update_order", (_VU_O, _decisions_sql("vu_d")))
def vacinacao_update_order(t):
    """C20 + W2 one by one: doses that move several times between scarce lots."""
    return ch.apply_vacinacao_update(_state(t, vacina="vacina_scarce"), t["vacinacao_chain_req"])[1]


@query("vacinacao_update_order_stock", (_VU_O, _stock_sql(
    "SELECT old_vac AS id_vacina, 1 AS d FROM vu_last WHERE id_vacina <> old_vac "
    "UNION ALL SELECT id_vacina, -1 FROM vu_last WHERE id_vacina <> old_vac").replace("FROM vacina v", "FROM vacina_scarce v")))
def vacinacao_update_order_stock(t):
    """C20 + W2: the scarce lots' stock after those moves."""
    return ch.apply_vacinacao_update(_state(t, vacina="vacina_scarce"), t["vacinacao_chain_req"])[0]["vacina"]


_AG_O = _over(_AG_S, {"agendamento_insert_req": "agendamento_chain_req"})


@query("agendamento_insert_order", (_AG_O, _decisions_sql("ag_sd", _AG_MAX)))
def agendamento_insert_order(t):
    """C16 strict + W4 one by one: a request that a full site refuses leaves its key free."""
    return ch.apply_agendamento_insert(_state(t), t["agendamento_chain_req"], strict=True)[1]


def _user_chain_sql(state: str = "bits") -> dict:
    """Each user's updates in their order; the role rows as bits (1 citizen, 2 administrator, 4 agent)."""
    shown = "CASE WHEN {b} % 2 = 1 THEN 1 WHEN {b} % 4 >= 2 THEN 2 WHEN {b} >= 4 THEN 4 ELSE 0 END"
    step = f"""CASE WHEN n.pre IS NOT NULL OR n.target = {shown.format(b='c.after')} THEN c.after
                    WHEN {shown.format(b='c.after')} = 1 AND n.cit_ref OR (c.after & n.target) > 0 THEN c.after
                    ELSE c.after - {shown.format(b='c.after')} + n.target END"""
    first = step.replace("c.after", "n.opening")
    return {
        "uc_j": f"""
            SELECT r.*, (EXISTS (SELECT 1 FROM vacinacao d WHERE d.cpf = r.cpf) OR EXISTS (SELECT 1 FROM agendamento a WHERE a.cpf = r.cpf)
                         OR EXISTS (SELECT 1 FROM parente p WHERE p.cpf_responsavel = r.cpf OR p.cpf_parente = r.cpf)) AS cit_ref,
                   CASE WHEN EXISTS (SELECT 1 FROM cidadao x WHERE x.cpf = r.cpf) THEN 1 ELSE 0 END
                   + CASE WHEN EXISTS (SELECT 1 FROM administrador x WHERE x.cpf = r.cpf) THEN 2 ELSE 0 END
                   + CASE WHEN EXISTS (SELECT 1 FROM agente_saude x WHERE x.cpf = r.cpf) THEN 4 ELSE 0 END AS opening,
                   CASE tipo_usuario WHEN 'Cidadão' THEN 1 WHEN 'Administrador' THEN 2 ELSE 4 END AS target,
                   CASE WHEN {STRIP.format(c='cpf_digitado')} IS DISTINCT FROM cpf THEN 'key_change'
                        WHEN NOT EXISTS (SELECT 1 FROM usuario u WHERE u.cpf = r.cpf) THEN 'no_match'
                        WHEN {_long(cpf=20, nome=100, telefone=100)} OR {_role_long('tipo_usuario')} THEN 'too_long'
                        WHEN nome IS NULL OR telefone IS NULL OR {_role_null('tipo_usuario')} THEN 'not_null' END AS pre,
                   row_number() OVER (PARTITION BY cpf ORDER BY req_seq) AS k
            FROM usuario_chain_req r""",
        "uc_c": f"""
            WITH RECURSIVE c AS (
              SELECT n.cpf, n.k, n.req_seq, n.opening AS before, {first} AS after FROM uc_j n WHERE n.k = 1
              UNION ALL
              SELECT n.cpf, n.k, n.req_seq, c.after, {step} FROM c JOIN uc_j n ON n.cpf = c.cpf AND n.k = c.k + 1)
            SELECT * FROM c""",
        "uc_d": f"""
            SELECT j.*, before, after,
                   CASE WHEN pre IS NOT NULL THEN pre
                        WHEN target <> {shown.format(b='before')} AND {shown.format(b='before')} = 1 AND cit_ref THEN 'fk_violation'
                        WHEN target <> {shown.format(b='before')} AND (before & target) > 0 THEN 'duplicate' END AS reason
            FROM uc_j j JOIN uc_c c ON j.req_seq = c.req_seq""",
    }


_UC = _user_chain_sql()


@query("usuario_update_order", (_UC, _decisions_sql("uc_d")))
def usuario_update_order(t):
    """C2 one by one: users who change their role several times in a batch."""
    return ch.apply_usuario_update(_state(t), t["usuario_chain_req"])[1]


_UC_END = dict(_UC)
_UC_END["uc_end"] = "SELECT cpf, arg_max(after, req_seq) AS bits FROM uc_d GROUP BY cpf"


@query("usuario_update_order_roles", (_UC_END, """
    SELECT u.cpf, coalesce(e.bits % 2 = 1, EXISTS (SELECT 1 FROM cidadao x WHERE x.cpf = u.cpf)) AS cidadao,
           coalesce(e.bits % 4 >= 2, EXISTS (SELECT 1 FROM administrador x WHERE x.cpf = u.cpf)) AS administrador,
           coalesce(e.bits >= 4, EXISTS (SELECT 1 FROM agente_saude x WHERE x.cpf = u.cpf)) AS agente_saude
    FROM usuario u LEFT JOIN uc_end e ON u.cpf = e.cpf"""))
def usuario_update_order_roles(t):
    """The role rows that each user has after those updates."""
    from pyspark.sql import functions as F
    new, _ = ch.apply_usuario_update(_state(t), t["usuario_chain_req"])
    out = new["usuario"].select("cpf")
    for table in ("cidadao", "administrador", "agente_saude"):
        out = out.join(new[table].select("cpf", F.lit(True).alias(table)), "cpf", "left")
    return out.select("cpf", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("cidadao", "administrador", "agente_saude")])


# ---------------------------------------------------------------------- C19, C20 and C21 in one order

_DC = {
    "dc_j": f"""
        SELECT r.req_seq, r.kind, CASE WHEN r.kind <> 'insert' THEN r.id_vacinacao END AS id_vacinacao, r.contagem, r.data_aplicacao,
               r.id_vacina, r.cpf, r.id_local, r.id_campanha, o.id_vacina AS old_vac, o.id_vacinacao IS NOT NULL AS found, v.qtd_doses AS stock,
               coalesce(r.kind IN ('insert', 'update'), false) AS put,
               ({_miss_text('r.cpf')} OR (r.kind = 'insert' AND ({_miss_int('r.id_vacina', 'r.id_local', 'r.id_campanha')}))) AS c_miss,
               coalesce(r.contagem < 1, false) AS c_oor, {_long(**{'r.cpf': 20})} AS c_long,
               (r.contagem IS NULL OR r.data_aplicacao IS NULL) AS c_null,
               NOT EXISTS (SELECT 1 FROM cidadao c WHERE c.cpf = r.cpf) AS c_cit,
               NOT (EXISTS (SELECT 1 FROM local l WHERE l.id_local = r.id_local)
                    AND EXISTS (SELECT 1 FROM campanha k WHERE k.id_campanha = r.id_campanha)
                    AND (r.kind = 'insert' OR v.id_vacina IS NOT NULL)) AS c_fk
        FROM (SELECT * REPLACE ({STRIP.format(c='cpf')} AS cpf) FROM vacinacao_mixed_req) r
        LEFT JOIN vacinacao o ON r.kind <> 'insert' AND r.id_vacinacao = o.id_vacinacao
        LEFT JOIN vacina_scarce v ON r.id_vacina = v.id_vacina""",
    "dc_p": """
        SELECT *, CASE WHEN kind NOT IN ('insert', 'update', 'delete') THEN 'unknown_kind' WHEN NOT put THEN NULL
                       WHEN c_miss THEN 'missing_field' WHEN c_oor THEN 'out_of_range' WHEN c_cit THEN 'not_citizen' END AS early,
               CASE WHEN NOT put THEN NULL WHEN c_long THEN 'too_long' WHEN c_null THEN 'not_null' END AS late,
               CASE WHEN put AND c_fk THEN 'fk_violation' END AS broken
        FROM dc_j""",
    "dc_o": f"""
        WITH RECURSIVE rounds AS (
          SELECT req_seq, kind, id_vacinacao, id_vacina, old_vac, found, stock, early IS NULL AND late IS NULL AS reach,
                 early IS NULL AND late IS NULL AND broken IS NULL AS valid, early IS NULL AND late IS NULL AND broken IS NULL AS acc,
                 false AS short, true AS there, cast(NULL AS bigint) AS dose, true AS changed, 0 AS n FROM dc_p
          UNION ALL
          SELECT req_seq, kind, id_vacinacao, id_vacina, old_vac, found, stock, reach, valid, valid AND now_there AND NOT now_short, now_short,
                 now_there, now_dose, bool_or((valid AND now_there AND NOT now_short) <> acc) OVER (), n + 1
          FROM (
            SELECT req_seq, any_value(kind) AS kind, any_value(id_vacinacao) AS id_vacinacao, any_value(id_vacina) AS id_vacina,
                   any_value(old_vac) AS old_vac, any_value(found) AS found, any_value(stock) AS stock, any_value(reach) AS reach,
                   any_value(valid) AS valid, any_value(acc) AS acc, any_value(now_there) AS now_there, any_value(now_dose) AS now_dose,
                   any_value(n) AS n,
                   coalesce(bool_or(e.asks AND (stock IS NULL OR stock < 0 OR stock + run - e.d - least(0, coalesce(stock + low, 0)) < 1)), false)
                   AS now_short
            FROM (
              SELECT *, min(run) OVER (PARTITION BY e.lot ORDER BY req_seq {PRECEDING}) AS low
              FROM (
                SELECT *, sum(e.d) OVER (PARTITION BY e.lot ORDER BY req_seq {RUNNING}) AS run
                FROM (
                  SELECT *, unnest([CASE WHEN reach AND (kind = 'insert' OR moves)
                                         THEN {{'lot': id_vacina, 'd': CASE WHEN valid THEN -1 ELSE 0 END, 'asks': true}}
                                         ELSE {{'lot': NULL, 'd': 0, 'asks': false}} END,
                                    CASE WHEN acc AND (moves OR (kind = 'delete' AND now_there)) THEN {{'lot': lot_now, 'd': 1, 'asks': false}}
                                         ELSE {{'lot': NULL, 'd': 0, 'asks': false}} END]) AS e
                  FROM (
                    SELECT *, kind = 'update' AND now_there AND id_vacina IS DISTINCT FROM lot_now AS moves
                    FROM (
                      SELECT *, kind = 'insert' OR coalesce(seen_there, found) AS now_there,
                             CASE WHEN seen_there IS NULL THEN old_vac ELSE seen_lot END AS lot_now
                      FROM (
                        SELECT *, last_value(CASE WHEN acc THEN kind <> 'delete' END IGNORE NULLS) OVER w AS seen_there,
                               last_value(CASE WHEN acc THEN CASE WHEN kind = 'delete' THEN -1 ELSE id_vacina END END IGNORE NULLS) OVER w AS seen_lot
                        FROM (
                          SELECT *, coalesce(CASE WHEN kind <> 'insert' THEN id_vacinacao WHEN acc THEN
                                      (SELECT coalesce(max(id_vacinacao), 0) FROM vacinacao)
                                      + cast(sum(CASE WHEN acc AND kind = 'insert' THEN 1 ELSE 0 END) OVER (ORDER BY req_seq {RUNNING}) AS bigint)
                                    END, -1 - req_seq) AS now_dose
                          FROM rounds WHERE changed) a
                        WINDOW w AS (PARTITION BY now_dose ORDER BY req_seq {PRECEDING})) b) c) d) f) g) h
            GROUP BY req_seq) x)
        SELECT req_seq, short, there, dose FROM (SELECT *, max(n) OVER () AS last_n FROM rounds) z WHERE n = last_n""",
    "dc_d": """
        SELECT p.* EXCLUDE (id_vacinacao), o.dose AS id_vacinacao,
               coalesce(early, CASE WHEN NOT there THEN 'no_match' END, late, CASE WHEN short THEN 'no_stock' END, broken) AS reason
        FROM dc_p p JOIN dc_o o ON p.req_seq = o.req_seq""",
}
_DC["dc_last"] = f"SELECT * FROM {_last_sql('dc_d', 'id_vacinacao')} l"


def _dose_changes(t):
    return apply_vacinacao_changes(_state(t, vacina="vacina_scarce"), t["vacinacao_mixed_req"])


@query("vacinacao_mixed", (_DC, """
    SELECT cast(req_seq AS bigint) AS req_seq, reason IS NULL OR reason = 'no_match' AS accepted, reason,
           CASE WHEN reason IS NULL AND kind = 'insert' THEN cast(id_vacinacao AS bigint) END AS new_id FROM dc_d"""))
def vacinacao_mixed(t):
    """C19, C20 and C21 in one ordered batch over scarce lots: the decisions."""
    return _dose_changes(t)[1]


@query("vacinacao_mixed_state", (_DC, """
    SELECT * FROM vacinacao v WHERE NOT EXISTS (SELECT 1 FROM dc_last u WHERE u.id_vacinacao = v.id_vacinacao)
    UNION ALL BY NAME
    SELECT id_vacinacao, contagem, data_aplicacao, id_vacina, cpf, id_local, id_campanha FROM dc_last WHERE kind <> 'delete'"""))
def vacinacao_mixed_state(t):
    """The doses after that batch."""
    return _dose_changes(t)[0]["vacinacao"]


@query("vacinacao_mixed_stock", (_DC, _stock_sql(
    "SELECT old_vac AS id_vacina, 1 AS d FROM dc_last WHERE found UNION ALL SELECT id_vacina, -1 FROM dc_last WHERE kind <> 'delete'")
    .replace("FROM vacina v", "FROM vacina_scarce v")))
def vacinacao_mixed_stock(t):
    """The scarce lots' stock after that batch."""
    return _dose_changes(t)[0]["vacina"]
