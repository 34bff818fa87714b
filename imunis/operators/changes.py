"""Change operators (C1–C21): a batch of requests in, new tables and one
decision per request out.

``apply_x(state, requests, ...) -> (new_state, decisions)``

* ``state`` maps table names to DataFrames (the snapshot the batch reads);
  ``new_state`` holds the tables the batch changes.
* ``requests`` carries ``req_seq`` (unique arrival order) and the payload.
* ``decisions(req_seq, accepted, reason, new_id)``: ``reason`` is the first
  failing check, NULL when the change was applied, ``no_match`` (accepted,
  no effect) when an update or delete finds no row.

Checks run in the order of the forms: what the form itself refuses comes
first (``missing_field``; ``not_offered``, only with ``check_options=True``;
``out_of_range``, ``bad_dates``, ``self_link``, ``not_citizen``), then
``no_match``, then what the database refuses (``too_long``, ``not_null``,
``duplicate``, ``no_stock``, ``fk_violation``; the operator says in which order).
A rejected request changes nothing. Several updates of one key: the last
accepted one wins. Several deletes of one key: the first is applied, the
others are ``no_match``. Uniqueness, stock and seats count only requests
that are valid in every other way (``serial.prefix_count``).

``req_seq`` must be unique within a batch (``require_unique_seq`` checks it).

All of it is joins, grouped aggregates and bounded windows; no request is
handled on the driver and nothing is collected. Each running count reads a
checkpoint of the requests, and the final judgement (reason, id) is
checkpointed once; decisions and new tables are derived from that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.schemas import (ROLE_ADMIN, ROLE_AGENTE, ROLE_CIDADAO, TABLES)
from ..session import cut_lineage
from . import filters as flt
from . import serial
from .rules import key_flag

State = Mapping[str, DataFrame]

ACCEPTING = ("no_match",)


# ----------------------------------------------------------------- helpers

def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """The code of the first true condition (NULL conditions count as false)."""
    out = None
    for cond, code in checks:
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out if out is not None else F.lit(None).cast("string")


def is_accepted(reason: Column) -> Column:
    return reason.isNull() | reason.isin(*ACCEPTING)


def decisions(judged: DataFrame, new_id: str | None = None) -> DataFrame:
    nid = F.col(new_id).cast("bigint") if new_id else F.lit(None).cast("bigint")
    return judged.select(F.col("req_seq").cast("bigint").alias("req_seq"),
                         is_accepted(F.col("reason")).alias("accepted"), "reason", nid.alias("new_id"))


def missing(col: str, kind: str) -> Column:
    if kind == "text":
        return C.missing_text(col)
    if kind == "int":
        return C.missing_int(col)
    if kind == "lot":  # the form's integer: 0 is falsy
        return C.missing_text(col) | F.col(col).rlike("^0+$")
    return C.missing_date(col)


def any_of(conds: Sequence[Column]) -> Column:
    out = None
    for c in conds:
        c = F.coalesce(c, F.lit(False))
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


def too_long(table: str, cols: Sequence[str] | None = None) -> Column:
    spec = TABLES[table]
    return any_of([F.char_length(c) > n for c, n in spec.lengths.items() if cols is None or c in cols])


def not_null(table: str, cols: Sequence[str]) -> Column:
    return any_of([F.col(c).isNull() for c in cols])


def exists_in(df: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]], flag: str) -> DataFrame:
    """``flag`` = the row's ``on`` columns match a row of a parent table, whose
    key is unique (K1)."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in on])
    return key_flag(df, keys, [c for c, _ in on], flag, unique=True)


def referenced(df: DataFrame, child: DataFrame, on: Sequence[tuple[str, str]], flag: str) -> DataFrame:
    """``flag`` = some ``child`` row references the row's key. Child values are
    made distinct first, so a key that a third of the child rows share is
    collapsed map-side before the shuffle."""
    keys = child.select(*[F.col(p).alias(c) for c, p in on])
    return key_flag(df, keys, [c for c, _ in on], flag)


def _maybe_cut(df: DataFrame, materialize: bool) -> DataFrame:
    """Materialize the judged requests once before they fan out into several
    branches (running counts, ids, decisions, new tables). Column pruning
    makes those branches differ, so without this Spark would recompute the
    whole upstream (scans, joins) per branch. A reliable checkpoint into the
    cluster's checkpoint folder also cuts the lineage a lost executor would
    replay."""
    return cut_lineage(df) if materialize else df


def apply_updates(table: DataFrame, key: Sequence[str], updates: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace ``cols`` of the rows whose key is in ``updates`` (one row per key)."""
    u = updates.select(*key, *[F.col(c).alias(f"_u_{c}") for c in cols], F.lit(True).alias("_u_hit"))
    j = table.join(u, list(key), "left")
    out = [F.when(F.col("_u_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
           for c in table.columns]
    return j.select(*out)


def _with_ids(table: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    spec = TABLES[[n for n, s in TABLES.items() if s.serial == id_col][0]]
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields])


def require_unique_seq(requests: DataFrame) -> None:
    """Raise ValueError if a ``req_seq`` occurs twice (or is NULL) in the batch."""
    bad = requests.groupBy("req_seq").count().where("count > 1 OR req_seq IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"req_seq {bad[0]['req_seq']} occurs {bad[0]['count']} times in one batch")


# ----------------------------------------------------------------- options (K7)

def offered_vacinas(state: State, as_of) -> DataFrame:
    return flt.vacinas_validas(state["vacina"], as_of, ordered=False).select("id_vacina")


def offered_campanhas(state: State, as_of) -> DataFrame:
    return flt.campanhas_ativas(state["campanha"], as_of, ordered=False).select("id_campanha")


# ----------------------------------------------------------------- simple entities

@dataclass(frozen=True)
class Entity:
    """Single-table change rules for vacina, campanha and local."""
    table: str
    required: dict[str, str]
    range_checks: tuple = ()                   # (lambda: Column) -> out_of_range
    own_checks: tuple = ()                     # (lambda: Column, code)
    in_use: tuple = ()                         # (table, column) that block a delete
    fk_refs: tuple = ()                        # (table, column) whose rows would break
    write: dict = field(default_factory=dict)  # column -> (lambda: Column) applied before storing

    @property
    def key(self) -> str:
        return TABLES[self.table].key[0]

    @property
    def payload(self) -> list[str]:
        return [f.name for f in TABLES[self.table].schema.fields if f.name != self.key]


VACINA_RULES = Entity(
    "vacina",
    required={"nome": "text", "doenca_alvo": "text", "codigo_lote": "lot",
              "data_chegada": "date", "data_validade": "date"},
    range_checks=(lambda: F.col("qtd_doses") < 0, lambda: ~F.col("codigo_lote").rlike("^[0-9]+$")),
    own_checks=((lambda: F.col("data_validade") <= F.col("data_chegada"), "bad_dates"),),
    in_use=(("vacinacao", "id_vacina"),),
    fk_refs=(("agendamento", "id_vacina"),),
)

CAMPANHA_RULES = Entity(
    "campanha",
    required={"nome": "text", "doenca_alvo": "text", "data_inicio": "date", "publico_alvo": "text"},
    own_checks=((lambda: F.col("data_fim").isNotNull() & (F.col("data_fim") < F.col("data_inicio")), "bad_dates"),),
    in_use=(("vacinacao", "id_campanha"),),
)

LOCAL_RULES = Entity(
    "local",
    required={"nome": "text", "rua": "text", "bairro": "text", "numero": "int", "cidade": "text",
              "estado": "text", "contato": "text"},
    range_checks=(lambda: F.col("numero") < 1, lambda: F.char_length("estado") > 2),
    in_use=(("vacinacao", "id_local"), ("agendamento", "id_local")),
    write={"capacidade": lambda: C.positive_or_null("capacidade")},
)


def _form_checks(e: Entity) -> list[tuple[Column, str]]:
    checks = [(any_of([missing(c, k) for c, k in e.required.items()]), "missing_field")]
    checks.append((any_of([f() for f in e.range_checks]), "out_of_range"))
    return checks + [(f(), code) for f, code in e.own_checks]


def _table_checks(e: Entity) -> list[tuple[Column, str]]:
    nn = [c for c in TABLES[e.table].not_null if c != e.key]
    return [(too_long(e.table), "too_long"), (not_null(e.table, nn), "not_null")]


def _stored(e: Entity, df: DataFrame) -> DataFrame:
    for c, f in e.write.items():
        df = df.withColumn(c, f())
    return df


def apply_entity_insert(e: Entity, state: State, requests: DataFrame, materialize: bool = True,
                        id_base: int | None = None):
    """``id_base``: the last id handed out, when the caller tracks it, instead
    of a max over the table (so on all inserts)."""
    table = state[e.table]
    j = _maybe_cut(requests.withColumn("reason", first_reason(_form_checks(e) + _table_checks(e))), materialize)
    j = _with_new_id(j, table, e.key, materialize, id_base)
    rows = _stored(e, j.where(F.col("reason").isNull()).withColumn(e.key, F.col("new_id")))
    new_table = table.unionByName(_with_ids(table, rows, e.key))
    return {e.table: new_table}, decisions(j, "new_id")


def _with_new_id(j: DataFrame, table: DataFrame, key: str, materialize: bool, id_base: int | None,
                 block: int = serial.DEFAULT_BLOCK) -> DataFrame:
    """K5 for the accepted requests; the judgement ends here and is kept."""
    return _maybe_cut(serial.allocate_ids(j, F.col("reason").isNull(), "req_seq", table, key, "new_id", block,
                                          base=id_base), materialize)


def apply_entity_update(e: Entity, state: State, requests: DataFrame, materialize: bool = True):
    table = state[e.table]
    j = exists_in(requests, table, [(e.key, e.key)], "_found")
    checks = _form_checks(e) + [(~F.col("_found"), "no_match")] + _table_checks(e)
    j = _maybe_cut(j.withColumn("reason", first_reason(checks)), materialize)
    ok = _stored(e, j.where(F.col("reason").isNull()))
    last = serial.last_per_key(ok.select("req_seq", e.key, *e.payload), [e.key], "req_seq")
    new_table = apply_updates(table, [e.key], last, e.payload)
    return {e.table: new_table}, decisions(j)


def _delete_judge(requests: DataFrame, table: DataFrame, key: str, blockers: Sequence[tuple[DataFrame, str, str]],
                  materialize: bool = True):
    """Shared delete logic: no_match, blocking references, first delete wins."""
    j = exists_in(requests, table, [(key, key)], "_found")
    checks = [(~F.col("_found"), "no_match")]
    for i, (child, col, code) in enumerate(blockers):
        j = referenced(j, child, [(key, col)], f"_ref{i}")
        checks.append((F.col(f"_ref{i}"), code))
    j = _maybe_cut(j.withColumn("_pre", first_reason(checks)), materialize)
    j = serial.first_in_group(j, [key], "req_seq", F.col("_pre").isNull(), "_first")
    return _maybe_cut(j.withColumn("reason", F.when(F.col("_pre").isNull() & ~F.col("_first"), F.lit("no_match"))
                                   .otherwise(F.col("_pre"))).drop("_pre", "_first"), materialize)


def apply_entity_delete(e: Entity, state: State, requests: DataFrame, materialize: bool = True):
    table = state[e.table]
    blockers = [(state[t], c, "in_use") for t, c in e.in_use] + [(state[t], c, "fk_violation") for t, c in e.fk_refs]
    j = _delete_judge(requests, table, e.key, blockers, materialize)
    gone = j.where(F.col("reason").isNull()).select(e.key)
    return {e.table: table.join(gone, e.key, "left_anti")}, decisions(j)


def apply_vacina_insert(state, requests, **kw):
    """C4."""
    return apply_entity_insert(VACINA_RULES, state, requests, **kw)


def apply_vacina_update(state, requests, **kw):
    """All six columns replaced (stock too)."""
    return apply_entity_update(VACINA_RULES, state, requests, **kw)


def apply_vacina_delete(state, requests, **kw):
    """Refused while doses use the lot (in_use) or appointments do (fk)."""
    return apply_entity_delete(VACINA_RULES, state, requests, **kw)


def apply_campanha_insert(state, requests, **kw):
    """C7."""
    return apply_entity_insert(CAMPANHA_RULES, state, requests, **kw)


def apply_campanha_update(state, requests, **kw):
    """The end date may become NULL."""
    return apply_entity_update(CAMPANHA_RULES, state, requests, **kw)


def apply_campanha_delete(state, requests, **kw):
    """C9."""
    return apply_entity_delete(CAMPANHA_RULES, state, requests, **kw)


def apply_local_insert(state, requests, **kw):
    """Non-positive capacity stored as NULL."""
    return apply_entity_insert(LOCAL_RULES, state, requests, **kw)


def apply_local_update(state, requests, **kw):
    """C11."""
    return apply_entity_update(LOCAL_RULES, state, requests, **kw)


def apply_local_delete(state, requests, **kw):
    """Refused while doses or appointments use the site."""
    return apply_entity_delete(LOCAL_RULES, state, requests, **kw)


# ----------------------------------------------------------------- parente

def _citizen_options(state: State, j: DataFrame, cols: Sequence[str], flag: str) -> DataFrame:
    for i, c in enumerate(cols):
        j = exists_in(j, state["cidadao"], [(c, "cpf")], f"{flag}{i}")
    return j.withColumn(flag, any_of([~F.col(f"{flag}{i}") for i in range(len(cols))])) \
        .drop(*[f"{flag}{i}" for i in range(len(cols))])


def apply_parente_insert(state: State, requests: DataFrame, check_options: bool = False, materialize: bool = True,
                         id_base: int | None = None):
    """Missing -> self link -> ordered pair exists (table or earlier in the
    batch) -> too long -> both ends must be citizens (fk)."""
    table = state["parente"]
    pair = ["cpf_responsavel", "cpf_parente"]
    j = _citizen_options(state, requests, pair, "_nc")
    j = referenced(j, table, [(c, c) for c in pair], "_dup_t")
    base = [(any_of([missing(c, "text") for c in pair]), "missing_field")]
    if check_options:
        base.append((F.col("_nc"), "not_offered"))
    base.append((F.col("cpf_responsavel") == F.col("cpf_parente"), "self_link"))
    fk = [(too_long("parente"), "too_long"), (F.col("_nc"), "fk_violation")]
    j = _maybe_cut(j.withColumn("_other", first_reason(base + fk)), materialize)
    j = serial.first_in_group(j, pair, "req_seq", F.col("_other").isNull() & ~F.col("_dup_t"), "_first")
    dup = F.col("_dup_t") | ~F.col("_first")
    j = _maybe_cut(j.withColumn("reason", first_reason(base + [(dup, "duplicate")] + fk)), materialize)
    j = _with_new_id(j, table, "id_parentesco", materialize, id_base)
    rows = j.where(F.col("reason").isNull()).withColumn("id_parentesco", F.col("new_id"))
    return {"parente": table.unionByName(_with_ids(table, rows, "id_parentesco"))}, decisions(j, "new_id")


def apply_parente_update(state: State, requests: DataFrame, check_options: bool = False, materialize: bool = True):
    """C14: missing -> self link -> no such link -> fk; no duplicate check."""
    table = state["parente"]
    pair = ["cpf_responsavel", "cpf_parente"]
    j = exists_in(requests, table, [("id_parentesco", "id_parentesco")], "_found")
    j = _citizen_options(state, j, pair, "_nc")
    checks = [(any_of([missing(c, "text") for c in pair]), "missing_field")]
    if check_options:
        checks.append((F.col("_nc"), "not_offered"))
    checks += [(F.col("cpf_responsavel") == F.col("cpf_parente"), "self_link"), (~F.col("_found"), "no_match"),
               (too_long("parente"), "too_long"), (F.col("_nc"), "fk_violation")]
    j = _maybe_cut(j.withColumn("reason", first_reason(checks)), materialize)
    last = serial.last_per_key(j.where(F.col("reason").isNull()).select("req_seq", "id_parentesco", *pair),
                               ["id_parentesco"], "req_seq")
    return {"parente": apply_updates(table, ["id_parentesco"], last, pair)}, decisions(j)


def apply_parente_delete(state: State, requests: DataFrame, materialize: bool = True):
    """C15."""
    table = state["parente"]
    j = _delete_judge(requests, table, "id_parentesco", [], materialize)
    gone = j.where(F.col("reason").isNull()).select("id_parentesco")
    return {"parente": table.join(gone, "id_parentesco", "left_anti")}, decisions(j)


# ----------------------------------------------------------------- agendamento

AGENDAMENTO_REQUIRED = {"cpf": "text", "id_campanha": "int", "id_vacina": "int", "id_local": "int",
                        "data_agendamento": "date"}


def _agendamento_flags(state: State, j: DataFrame, check_options: bool, as_of) -> DataFrame:
    # Missing is judged on the text as typed; it is stripped when it is written.
    j = j.withColumn("_miss", any_of([missing(c, k) for c, k in AGENDAMENTO_REQUIRED.items()])) \
        .withColumn("cpf", C.strip_ws("cpf"))
    j = exists_in(j, state["cidadao"], [("cpf", "cpf")], "_fk_cpf")
    j = exists_in(j, state["vacina"], [("id_vacina", "id_vacina")], "_fk_vac")
    j = exists_in(j, state["local"], [("id_local", "id_local")], "_fk_loc")
    if check_options:
        j = exists_in(j, offered_vacinas(state, as_of), [("id_vacina", "id_vacina")], "_op_vac")
        j = exists_in(j, offered_campanhas(state, as_of), [("id_campanha", "id_campanha")], "_op_camp")
        j = j.withColumn("_not_offered", ~(F.col("_op_vac") & F.col("_op_camp") & F.col("_fk_loc")))
    return j.withColumn("_fk", ~(F.col("_fk_cpf") & F.col("_fk_vac") & F.col("_fk_loc")))


#: Rows up to which a side of a join is sent to all tasks, once it has been counted.
FEW = 1 << 16


def _if_few(df: DataFrame) -> DataFrame:
    """``df`` (materialized), to be broadcast if it has at most ``FEW`` rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


_BOOKING = ["cpf", "id_vacina", "data_agendamento"]
_SLOT = ["id_local", "data_agendamento"]


def _seat_candidates(j: DataFrame, materialize: bool) -> DataFrame:
    """The requests that may get a seat, as (key, site, ``req_seq``, ``_room``), with their place ``_o`` at the site and day.

    Of one key's requests for one site only the first can be accepted: the
    others come after a duplicate, after the accepted one, or to a full site.
    And a site is full after as many keys as the day has seats at all sites
    together: each of them has got a seat by then, here or elsewhere.
    """
    key = [*_BOOKING, "id_local"]
    open_ = j.where("_v0 and not _dup_t and _room > 0")
    first = _maybe_cut(open_.groupBy(*key).agg(F.min("req_seq").alias("req_seq"), F.max("_room").alias("_room")), materialize)
    rooms = first.groupBy(*_SLOT).agg(F.max("_room").alias("_r")).groupBy("data_agendamento").agg(F.sum("_r").alias("_seats"))
    ranked = serial.prefix_count(first.select(*key, "req_seq"), _SLOT, "req_seq", F.lit(True), "_at")
    near = _maybe_cut(ranked.join(rooms, "data_agendamento").where("_at < _seats").drop("_at", "_seats"), materialize)
    # Rows with the same request (a parent table that repeats a key makes some) ask for a seat each.
    rows = open_.select(*key, "req_seq", "_room").join(_if_few(near), [*key, "req_seq"])
    return _maybe_cut(serial.prefix_count(rows, _SLOT, "req_seq", F.lit(True), "_o"), materialize)


def _strict_order(j: DataFrame, valid: Column, materialize: bool) -> tuple[DataFrame, list[tuple[Column, str]]]:
    """The duplicate and seat rules as if the requests came one by one.

    A request is a duplicate of an earlier *accepted* one, and only requests
    that are none ask for a seat; so the two rules depend on each other. Rounds
    settle who is accepted among the requests that may be (``_seat_candidates``):
    a request is accepted if no undecided or accepted one of its key is earlier
    and those before it at its site leave a seat; it is refused if an accepted
    one of its key is earlier or the accepted ones before it fill the site.
    Each round settles at least the next request of every chain, and settled
    requests stay only where undecided ones ask for the same site and day. The
    batch itself is read once more, to look up each request's key and site.
    """
    j = j.withColumn("_v0", valid).withColumn("_room", F.coalesce(F.col("_cap"), F.lit(0)) - F.coalesce(F.col("_booked"), F.lit(0)))
    asked = _seat_candidates(j, materialize)
    crowded = not asked.groupBy(*_SLOT).count().where(F.col("count") > serial.DEFAULT_BLOCK).isEmpty()
    held, got = asked.withColumn("_acc", F.lit(False)), []
    while True:
        before = Window.partitionBy(*_BOOKING)
        now = held.withColumn("_first", F.min("req_seq").over(before)).withColumn("_won", F.min(F.when(F.col("_acc"), F.col("req_seq"))).over(before))
        if crowded:
            now = serial.prefix_count(now, _SLOT, "_o", F.lit(True), "_most")
            now = serial.prefix_count(now, _SLOT, "_o", "_acc", "_least")
        else:
            line = Window.partitionBy(*_SLOT).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
            now = now.withColumn("_most", F.count(F.lit(1)).over(line)).withColumn("_least", F.count_if("_acc").over(line))
        sure = F.col("_first") >= F.col("req_seq")
        lost = ~F.col("_acc") & (F.coalesce(F.col("_won") < F.col("req_seq"), F.lit(False)) | (F.col("_least") >= F.col("_room")))
        now = _maybe_cut(now.select(*held.columns, (~F.col("_acc") & ~lost & sure & (F.col("_most") < F.col("_room"))).alias("_new"), lost.alias("_lost"))
                         .where("not _lost").drop("_lost"), materialize)
        got.append(now.where("_new").select(*asked.columns))
        open_ = _maybe_cut(now.where("not _acc and not _new").select(*_SLOT).distinct(), materialize)
        if open_.isEmpty():
            break
        # What was accepted just now still refuses later ones of its key elsewhere.
        there = now.join(_if_few(open_.withColumn("_open", F.lit(True))), _SLOT, "left").where("_open or _new")
        held = there.withColumn("_acc", F.col("_acc") | F.col("_new")).select(*asked.columns, "_acc")
    seats = _maybe_cut(reduce(DataFrame.unionAll, got), materialize)
    copies = asked.groupBy(*_BOOKING, "id_local", "req_seq").agg(F.count(F.lit(1)).alias("_copies"))
    taken = _maybe_cut(seats.groupBy(*_BOOKING, "id_local", "req_seq").agg(F.count(F.lit(1)).alias("_got")).join(
        copies, [*_BOOKING, "id_local", "req_seq"]).withColumnsRenamed({"req_seq": "_first", "id_local": "_site"}), materialize)
    last = _maybe_cut(seats.groupBy(*_SLOT).agg(F.count(F.lit(1)).alias("_gone"), F.max("req_seq").alias("_last")), materialize)
    # Of a request's equal rows some may get a seat and some not.
    copy = F.lit(1) if taken.where("_got < _copies").isEmpty() \
        else F.row_number().over(Window.partitionBy(*_BOOKING, "id_local", "req_seq").orderBy(F.col("_v0").desc()))
    j = j.withColumn("_copy", copy).join(_if_few(taken), _BOOKING, "left").join(_if_few(last), _SLOT, "left")
    j = j.withColumn("_dup", F.col("_dup_t") | F.coalesce(F.col("_first") < F.col("req_seq"), F.lit(False)))
    mine = (F.col("_first") == F.col("req_seq")) & (F.col("_site") == F.col("id_local")) & (F.col("_copy") <= F.col("_got"))
    late = (F.col("_room") <= 0) | F.coalesce((F.col("_gone") >= F.col("_room")) & (F.col("_last") < F.col("req_seq")), F.lit(False))
    full = F.when(F.col("_v0") & ~F.col("_dup"), ~F.coalesce(mine, F.lit(False))).otherwise(late)
    return j, [(F.col("_dup"), "duplicate"), (full, "full")]


def apply_agendamento_insert(state: State, requests: DataFrame, strict: bool = False, check_options: bool = False,
                             as_of=None, materialize: bool = True, id_base: int | None = None):
    """C16. The campaign is asked for but not stored. ``strict`` adds the
    duplicate rule (V6) and the seat rule (V3/V4), with the outcome of requests
    that come one by one (``_strict_order``)."""
    table = state["agendamento"]
    j = _agendamento_flags(state, requests, check_options, as_of)
    if strict:
        j = referenced(j, table, [(c, c) for c in ("cpf", "id_vacina", "data_agendamento")], "_dup_t")
        # Seats taken and capacity: one row for each site and day, and for each site.
        booked = table.groupBy("id_local", "data_agendamento").agg(F.count(F.lit(1)).alias("_booked"))
        cap = state["local"].select("id_local", C.null_as_zero("capacidade").alias("_cap"))
        j = j.join(booked, ["id_local", "data_agendamento"], "left").join(cap, "id_local", "left")
    j = _maybe_cut(j, materialize)
    base = [(F.col("_miss"), "missing_field")]
    if check_options:
        base.append((F.col("_not_offered"), "not_offered"))
    base.append((too_long("agendamento"), "too_long"))
    fk = [(F.col("_fk"), "fk_violation")]
    own: list[tuple[Column, str]] = []
    if strict:
        j, own = _strict_order(j, first_reason(base + fk).isNull(), materialize)
    j = j.withColumn("reason", first_reason(base + own + fk))
    if strict:
        j = _maybe_cut(j.select(*requests.columns, "reason"), materialize)
    j = _with_new_id(j, table, "id_agendamento", materialize, id_base)
    rows = j.where(F.col("reason").isNull()).withColumn("id_agendamento", F.col("new_id"))
    return {"agendamento": table.unionByName(_with_ids(table, rows, "id_agendamento"))}, decisions(j, "new_id")


def apply_agendamento_update(state: State, requests: DataFrame, check_options: bool = False, as_of=None,
                             materialize: bool = True):
    """C17: as C16 without the strict rules; last accepted update wins."""
    table = state["agendamento"]
    j = exists_in(requests, table, [("id_agendamento", "id_agendamento")], "_found")
    j = _agendamento_flags(state, j, check_options, as_of)
    checks = [(F.col("_miss"), "missing_field")]
    if check_options:
        checks.append((F.col("_not_offered"), "not_offered"))
    checks += [(~F.col("_found"), "no_match"), (too_long("agendamento"), "too_long"), (F.col("_fk"), "fk_violation")]
    j = _maybe_cut(j.withColumn("reason", first_reason(checks)), materialize)
    cols = ["data_agendamento", "id_vacina", "id_local", "cpf"]
    last = serial.last_per_key(j.where(F.col("reason").isNull()).select("req_seq", "id_agendamento", *cols),
                               ["id_agendamento"], "req_seq")
    return {"agendamento": apply_updates(table, ["id_agendamento"], last, cols)}, decisions(j)


def apply_agendamento_delete(state: State, requests: DataFrame, materialize: bool = True):
    """Cancel; no checks."""
    table = state["agendamento"]
    j = _delete_judge(requests, table, "id_agendamento", [], materialize)
    gone = j.where(F.col("reason").isNull()).select("id_agendamento")
    return {"agendamento": table.join(gone, "id_agendamento", "left_anti")}, decisions(j)


# ----------------------------------------------------------------- vacinacao with stock

def stock_after(vacina: DataFrame, delta: DataFrame) -> DataFrame:
    """qtd_doses + summed delta per lot (``delta`` has id_vacina, _d)."""
    d = delta.groupBy("id_vacina").agg(F.sum("_d").alias("_delta"))
    return vacina.join(d, "id_vacina", "left").select(
        *[(F.col("qtd_doses") + F.coalesce(F.col("_delta"), F.lit(0))).cast("int").alias("qtd_doses")
          if c == "qtd_doses" else F.col(c) for c in vacina.columns])


def apply_vacinacao_insert(state: State, requests: DataFrame, check_options: bool = False, as_of=None,
                           materialize: bool = True, block: int = serial.DEFAULT_BLOCK, id_base: int | None = None):
    """C19 with W1: missing -> out of range -> not a citizen -> too long / not
    null -> lot unknown or out of stock -> fk -> insert, one dose taken from
    the lot.

    A request runs out of stock when the requests valid in every other way
    that come before it for the same lot already use the lot's opening stock.
    ``id_base``: the last id handed out, when the caller tracks it (the
    stream does), instead of a max over the dose table.
    """
    table = state["vacinacao"]
    j = requests.withColumn("cpf", C.strip_ws("cpf"))
    j = exists_in(j, state["cidadao"], [("cpf", "cpf")], "_cit")
    j = j.join(state["vacina"].select("id_vacina", F.col("qtd_doses").alias("_stock")), "id_vacina", "left")
    j = exists_in(j, state["local"], [("id_local", "id_local")], "_fk_loc")
    j = exists_in(j, state["campanha"], [("id_campanha", "id_campanha")], "_fk_camp")
    if check_options:
        j = exists_in(j, offered_vacinas(state, as_of), [("id_vacina", "id_vacina")], "_op_vac")
        j = exists_in(j, offered_campanhas(state, as_of), [("id_campanha", "id_campanha")], "_op_camp")
    req = [(any_of([missing("cpf", "text"), missing("id_vacina", "int"), missing("id_local", "int"),
                    missing("id_campanha", "int")]), "missing_field")]
    if check_options:
        req.append((~(F.col("_op_vac") & F.col("_op_camp") & F.col("_fk_loc")), "not_offered"))
    req += [(F.coalesce(F.col("contagem") < 1, F.lit(False)), "out_of_range"), (~F.col("_cit"), "not_citizen"),
            (too_long("vacinacao"), "too_long"),
            (not_null("vacinacao", ["contagem", "data_aplicacao"]), "not_null")]
    fk = [(~(F.col("_fk_loc") & F.col("_fk_camp")), "fk_violation")]
    j = _maybe_cut(j.withColumn("_valid", first_reason(req + fk).isNull()), materialize)
    j = serial.prefix_count(j, ["id_vacina"], "req_seq", F.col("_valid"), "_used_before", block)
    no_stock = F.col("_stock").isNull() | (F.col("_used_before") >= F.col("_stock"))
    j = _maybe_cut(j.withColumn("reason", first_reason(req + [(no_stock, "no_stock")] + fk)), materialize)
    j = _with_new_id(j, table, "id_vacinacao", materialize, id_base, block)
    ok = j.where(F.col("reason").isNull())
    rows = ok.withColumn("id_vacinacao", F.col("new_id"))
    new_vacina = stock_after(state["vacina"], ok.select("id_vacina", F.lit(-1).alias("_d")))
    return ({"vacinacao": table.unionByName(_with_ids(table, rows, "id_vacinacao")), "vacina": new_vacina},
            decisions(j, "new_id"))


VACINACAO_COLS = ["contagem", "data_aplicacao", "id_vacina", "cpf", "id_local", "id_campanha"]


def _lot_changes_in_order(j: DataFrame, materialize: bool, block: int) -> DataFrame:
    """(req_seq, _short): whether a lot change finds no dose, as if the requests came one by one.

    Lots are coupled: a change gives back to one and takes from another, and
    what lot a dose gives back to depends on the changes accepted before. Each
    round takes the last round's accepted requests for true, follows every dose
    from lot to lot, and walks every lot through its takes and returns in order
    (``serial.stock_before``), which settles all takes of a lot at once. What a
    request gets depends on earlier ones alone, so a round that changes nothing
    has the one-by-one outcome.
    """
    j = j.withColumn("_acc", F.col("_valid"))
    kept = j.columns
    several = not j.groupBy("id_vacinacao").count().where("count > 1").isEmpty()
    while True:
        now = serial.last_before(j, ["id_vacinacao"], "req_seq", "_acc", "id_vacina", "_lot", block) if several \
            else j.withColumn("_lot", F.lit(None).cast("bigint"))
        now = now.withColumn("_lot", F.coalesce("_lot", "_old_vac")).withColumn("_move", ~F.col("id_vacina").eqNullSafe(F.col("_lot")))
        take = F.struct(F.col("id_vacina").alias("lot"), F.when(F.col("_valid"), -1).otherwise(0).alias("delta"), F.lit(True).alias("asks"))
        back = F.struct(F.col("_lot").alias("lot"), F.lit(1).alias("delta"), F.lit(False).alias("asks"))
        events = now.where("_move").select("req_seq", "_stock", F.explode(
            F.when(F.col("_acc"), F.array(take, back)).otherwise(F.array(take))).alias("e")).select("req_seq", "_stock", "e.*")
        # A return's own stock is not asked for, so its row needs no opening stock.
        found = serial.stock_before(events, "lot", "req_seq", "delta", "_stock", "_left", block).where("asks").select("req_seq", "_left")
        short = F.col("_move") & (F.col("_stock").isNull() | (F.col("_stock") < 0) | (F.col("_left") < 1))
        now = now.join(found, "req_seq", "left").withColumn("_short", F.coalesce(short, F.lit(False)))
        now = _maybe_cut(now.withColumn("_now", F.col("_valid") & ~F.col("_short")).select(*kept, "_short", "_now"), materialize)
        if now.where("_now <> _acc").isEmpty():
            return now.select("req_seq", "_short")
        j = now.withColumn("_acc", F.col("_now")).select(*kept)


def apply_vacinacao_update(state: State, requests: DataFrame, check_options: bool = False, as_of=None,
                           materialize: bool = True, block: int = serial.DEFAULT_BLOCK):
    """C20 with W2: cpf empty -> out of range -> not a citizen -> no row -> too
    long / not null -> a lot change needs a dose of the new lot -> fk -> six
    columns replaced.

    The outcome is that of requests that come one by one: a lot change gives a
    dose back to the lot that the dose has by then and takes one from the new
    lot (``_lot_changes_in_order``). Per dose the last accepted update wins, so
    the ledger moves one dose from the opening lot to the final lot. A lot
    whose opening stock is below 0 gives nothing in the batch.
    """
    table = state["vacinacao"]
    old = table.select("id_vacinacao", F.col("id_vacina").alias("_old_vac"), F.lit(True).alias("_found"))
    j = requests.withColumn("cpf", C.strip_ws("cpf")).join(old, "id_vacinacao", "left") \
        .withColumn("_found", F.coalesce(F.col("_found"), F.lit(False)))
    j = exists_in(j, state["cidadao"], [("cpf", "cpf")], "_cit")
    j = j.join(state["vacina"].select("id_vacina", F.col("qtd_doses").alias("_stock")), "id_vacina", "left")
    j = exists_in(j, state["local"], [("id_local", "id_local")], "_fk_loc")
    j = exists_in(j, state["campanha"], [("id_campanha", "id_campanha")], "_fk_camp")
    if check_options:
        j = exists_in(j, offered_vacinas(state, as_of), [("id_vacina", "id_vacina")], "_op_vac")
        j = exists_in(j, offered_campanhas(state, as_of), [("id_campanha", "id_campanha")], "_op_camp")
    req = [(missing("cpf", "text"), "missing_field")]
    if check_options:
        req.append((~(F.col("_op_vac") & F.col("_op_camp") & F.col("_fk_loc")), "not_offered"))
    req += [(F.coalesce(F.col("contagem") < 1, F.lit(False)), "out_of_range"), (~F.col("_cit"), "not_citizen"),
            (~F.col("_found"), "no_match"), (too_long("vacinacao"), "too_long"),
            (not_null("vacinacao", ["contagem", "data_aplicacao"]), "not_null")]
    fk = [(~(F.col("_fk_loc") & F.col("_fk_camp") & F.col("_stock").isNotNull()), "fk_violation")]
    j = _maybe_cut(j.withColumn("_pre", first_reason(req)).withColumn("_valid", first_reason(req + fk).isNull()), materialize)
    order = _lot_changes_in_order(j.where("_pre is null").select("req_seq", "id_vacinacao", "id_vacina", "_old_vac", "_stock", "_valid"),
                                  materialize, block)
    j = j.join(order, "req_seq", "left")
    # A request that another check refuses still meets the stock first.
    no_stock = F.col("_short")
    j = _maybe_cut(j.withColumn("reason", F.coalesce("_pre", first_reason([(no_stock, "no_stock")] + fk))), materialize)
    ok = j.where(F.col("reason").isNull())
    last = serial.last_per_key(ok.select("req_seq", "id_vacinacao", "_old_vac", *VACINACAO_COLS),
                               ["id_vacinacao"], "req_seq")
    new_table = apply_updates(table, ["id_vacinacao"], last, VACINACAO_COLS)
    moved = last.where(F.col("id_vacina") != F.col("_old_vac"))
    delta = moved.select(F.col("_old_vac").alias("id_vacina"), F.lit(1).alias("_d")) \
        .unionByName(moved.select("id_vacina", F.lit(-1).alias("_d")))
    return {"vacinacao": new_table, "vacina": stock_after(state["vacina"], delta)}, decisions(j)


def apply_vacinacao_delete(state: State, requests: DataFrame, materialize: bool = True):
    """Delete, one dose back to the lot of each row really deleted."""
    table = state["vacinacao"]
    j = _delete_judge(requests, table, "id_vacinacao", [], materialize)
    gone = j.where(F.col("reason").isNull()).select("id_vacinacao")
    credited = table.join(gone, "id_vacinacao", "left_semi").select("id_vacina", F.lit(1).alias("_d"))
    return ({"vacinacao": table.join(gone, "id_vacinacao", "left_anti"),
             "vacina": stock_after(state["vacina"], credited)}, decisions(j))


# ----------------------------------------------------------------- usuario

ROLE_TABLES = {ROLE_CIDADAO: "cidadao", ROLE_ADMIN: "administrador", ROLE_AGENTE: "agente_saude"}


def _role_rows(df: DataFrame, role: str) -> DataFrame:
    table = ROLE_TABLES[role]
    return df.where(F.col("tipo_usuario") == role).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].schema.fields])


def _role_payload_checks(role_col: str = "tipo_usuario") -> tuple[Column, Column]:
    """(too_long, not_null) of the role row the request would write."""
    tl = (F.when(F.col(role_col) == ROLE_CIDADAO, too_long("cidadao"))
          .when(F.col(role_col) == ROLE_ADMIN, too_long("administrador"))
          .when(F.col(role_col) == ROLE_AGENTE, too_long("agente_saude")).otherwise(F.lit(False)))
    nn = (F.when(F.col(role_col) == ROLE_ADMIN, not_null("administrador", ["local_trabalho"]))
          .when(F.col(role_col) == ROLE_AGENTE, not_null("agente_saude", ["email", "posto_trabalho"]))
          .otherwise(F.lit(False)))
    return tl, nn


def _role_key_flags(state: State, j: DataFrame) -> DataFrame:
    for role, table in ROLE_TABLES.items():
        j = exists_in(j, state[table], [("cpf", "cpf")], f"_has_{table}")
    return j


def _has_role(col: str) -> Column:
    return (F.when(F.col(col) == ROLE_CIDADAO, F.col("_has_cidadao"))
            .when(F.col(col) == ROLE_ADMIN, F.col("_has_administrador"))
            .when(F.col(col) == ROLE_AGENTE, F.col("_has_agente_saude")).otherwise(F.lit(False)))


def apply_usuario_insert(state: State, requests: DataFrame, materialize: bool = True):
    """Missing -> too long -> cpf taken (table, role table or earlier in the
    batch) -> user row plus exactly one role row."""
    j = requests.withColumn("cpf", C.strip_ws("cpf"))
    j = exists_in(j, state["usuario"], [("cpf", "cpf")], "_taken")
    j = _role_key_flags(state, j)
    tl, nn = _role_payload_checks()
    base = [(any_of([missing(c, "text") for c in ("cpf", "nome", "telefone")]), "missing_field"),
            (too_long("usuario") | tl, "too_long"), (nn, "not_null")]
    j = _maybe_cut(j.withColumn("_v0", first_reason(base).isNull()), materialize)
    taken = F.col("_taken") | _has_role("tipo_usuario")
    j = serial.first_in_group(j, ["cpf"], "req_seq", F.col("_v0") & ~taken, "_first")
    j = _maybe_cut(j.withColumn("reason", first_reason(base + [(taken | ~F.col("_first"), "duplicate")])), materialize)
    ok = j.where(F.col("reason").isNull())
    new = {"usuario": state["usuario"].unionByName(ok.select("cpf", "nome", "telefone"))}
    for role, table in ROLE_TABLES.items():
        new[table] = state[table].unionByName(_role_rows(ok, role))
    return new, decisions(j)


#: Bit of each role in a user's role state; the list shows the lowest (P2 precedence).
ROLE_BITS = {ROLE_CIDADAO: 1, ROLE_ADMIN: 2, ROLE_AGENTE: 4}


def _shown_bit(state: int) -> int:
    return state & -state


def _role_step(target: int, referenced: bool) -> list[int]:
    """The role state after a valid update to ``target`` (0: no role of the three), for each state before it."""
    out = []
    for state in range(8):
        shown = _shown_bit(state)
        refused = shown != target and ((shown == 1 and referenced) or state & target)
        out.append(state if refused or shown == target else state & ~shown | target)
    return out


def _role_steps(valid: Column) -> Column:
    """The request's transition of role states, as an array."""
    keep = F.array(*[F.lit(i) for i in range(8)])
    out = F.when(~valid | F.col("tipo_usuario").isNull(), keep)
    for role, bit in [*ROLE_BITS.items(), (None, 0)]:
        for ref in (True, False):
            hit = F.lit(True) if role is None else F.col("tipo_usuario") == role
            out = out.when(hit & (F.col("_cit_ref") == ref), F.array(*[F.lit(x) for x in _role_step(bit, ref)]))
    return out.otherwise(keep)


def apply_usuario_update(state: State, requests: DataFrame, materialize: bool = True):
    """The typed cpf must equal the row's; name and phone replaced; same
    role -> its row updated; new role -> the shown role's row deleted (P2
    precedence) and the new one inserted. The old role row goes first, so a
    referenced citizen row (fk) is refused before a role row that already
    exists (duplicate). A typed cpf of NULL differs from the row's.

    Updates of one user see the roles that the accepted ones before them left
    (``serial.scan_states`` over the eight states of the three role rows)."""
    j = exists_in(requests, state["usuario"], [("cpf", "cpf")], "_found")
    j = _role_key_flags(state, j)
    refs = state["vacinacao"].select("cpf").unionByName(state["agendamento"].select("cpf")) \
        .unionByName(state["parente"].select(F.col("cpf_responsavel").alias("cpf"))) \
        .unionByName(state["parente"].select(F.col("cpf_parente").alias("cpf")))
    j = key_flag(j, refs, ["cpf"], "_cit_ref")
    opening = sum((F.when(F.col(f"_has_{ROLE_TABLES[r]}"), b).otherwise(0) for r, b in ROLE_BITS.items()), F.lit(0))
    tl, nn = _role_payload_checks()
    checks = [(~C.strip_ws("cpf_digitado").eqNullSafe(F.col("cpf")), "key_change"), (~F.col("_found"), "no_match"),
              (too_long("usuario") | tl, "too_long"), (not_null("usuario", ["nome", "telefone"]) | nn, "not_null")]
    j = j.withColumn("_pre", first_reason(checks)).withColumn("_opening", opening)
    j = _maybe_cut(j.withColumn("_step", _role_steps(F.col("_pre").isNull())), materialize)
    if j.where("_pre is null").groupBy("cpf").count().where("count > 1").isEmpty():
        j = j.withColumn("_roles", F.col("_opening"))
    else:
        slim = j.where("_pre is null").select("req_seq", "cpf", "_step", "_opening")
        seen = serial.scan_states(slim, "cpf", "req_seq", "_step", "_opening", 8, "_roles").select("req_seq", "_roles")
        j = _maybe_cut(j.join(seen, "req_seq", "left"), materialize)
    has = F.lit(False)
    for role, bit in ROLE_BITS.items():
        has = has | ((F.col("tipo_usuario") == role) & (F.col("_roles").bitwiseAND(bit) > 0))
    # The role the list shows at that moment.
    shown = C.role(*[F.when(F.col("_roles").bitwiseAND(ROLE_BITS[r]) > 0, F.lit(1)) for r in ROLE_BITS])
    change = F.col("tipo_usuario") != shown
    reason = first_reason([(F.col("_pre").isNotNull(), ""), (change & (shown == ROLE_CIDADAO) & F.col("_cit_ref"), "fk_violation"),
                           (change & has, "duplicate")])
    j = j.withColumn("reason", F.coalesce("_pre", reason)) \
        .withColumn("_after", F.element_at("_step", F.col("_roles") + 1))
    ok = j.where(F.col("reason").isNull())
    # One row for each user with an accepted update: the last one, and what the last one to each role wrote. A role's row
    # is as that update wrote it, if the user still has the role.
    payload = [c for c in requests.columns if c not in ("req_seq", "cpf", "cpf_digitado", "nome", "telefone", "tipo_usuario")]
    wrote = [F.max(F.when(F.col("tipo_usuario") == role, F.struct("req_seq", *payload))).alias(f"_{table}") for role, table in ROLE_TABLES.items()]
    ends = _maybe_cut(ok.groupBy("cpf").agg(F.max(F.struct("req_seq", "_opening", "_after", "nome", "telefone")).alias("_last"), *wrote)
                      .select("cpf", "_last.*", *[f"_{table}" for table in ROLE_TABLES.values()]).drop("req_seq"), materialize)
    new = {"usuario": apply_updates(state["usuario"], ["cpf"], ends, ["nome", "telefone"])}
    for role, table in ROLE_TABLES.items():
        bit = ROLE_BITS[role]
        fields = TABLES[table].schema.fields
        before, after = F.col("_opening").bitwiseAND(bit) > 0, F.col("_after").bitwiseAND(bit) > 0
        had = ends.where(before).select("cpf", after.alias("_stays"), F.col(f"_{table}").alias("_row"))
        rewritten = F.col("_row").isNotNull()
        kept = state[table].join(had, "cpf", "left").where(F.coalesce("_stays", F.lit(True))).select(
            *[F.col(f.name) if f.name == "cpf" else F.when(rewritten, F.col(f"_row.{f.name}")).otherwise(F.col(f.name)).alias(f.name) for f in fields])
        added = ends.where(~before & after & F.col(f"_{table}").isNotNull()).select(
            *[F.col("cpf" if f.name == "cpf" else f"_{table}.{f.name}").cast(f.dataType).alias(f.name) for f in fields])
        new[table] = kept.unionByName(added)
    return new, decisions(j)


def apply_usuario_delete(state: State, requests: DataFrame, materialize: bool = True):
    """Refused while doses exist (in_use) or a link/appointment references
    the citizen (fk); otherwise the three role rows and the user go."""
    blockers = [(state["vacinacao"], "cpf", "in_use"), (state["agendamento"], "cpf", "fk_violation"),
                (state["parente"], "cpf_responsavel", "fk_violation"), (state["parente"], "cpf_parente", "fk_violation")]
    j = _delete_judge(requests, state["usuario"], "cpf", blockers, materialize)
    gone = j.where(F.col("reason").isNull()).select("cpf")
    new = {t: state[t].join(gone, "cpf", "left_anti") for t in ("usuario", "cidadao", "administrador", "agente_saude")}
    return new, decisions(j)
