"""Inserts, updates and deletes of doses (C19, C20, C21) as one ordered batch.

The single operators take batches of one kind. A feed mixes the kinds: an
update finds the dose that an earlier request of the batch inserted, a delete
gives back the lot that an earlier update moved the dose to, and an insert gets
the dose of stock that a delete before it returned. Cutting the batch into runs
of one kind would take as many jobs as the kinds alternate, so the batch is
settled as a whole, in rounds, like the lot changes of C20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.schemas import TABLES
from . import serial
from .changes import (State, VACINACAO_COLS, _maybe_cut, _with_ids, any_of, decisions, exists_in, first_reason, missing,
                      not_null, offered_campanhas, offered_vacinas, stock_after, too_long)

INSERT, UPDATE, DELETE = "insert", "update", "delete"
KINDS = (INSERT, UPDATE, DELETE)


def _judge_alone(state: State, requests: DataFrame, check_options: bool, as_of) -> DataFrame:
    """What each request's own values and the tables that the batch leaves alone decide.

    ``_pre`` is the reason before a dose is looked for, ``_post`` the one
    between that and the stock, ``_fk`` the one behind the stock.
    """
    kind = F.col("kind")
    ins, put = kind == INSERT, kind.isin(INSERT, UPDATE)
    # A request without a dose of its own gets a key that no dose has: null keys would meet in one task.
    j = requests.select("req_seq", "kind", F.when(kind != INSERT, F.col("id_vacinacao")).alias("id_vacinacao"), *VACINACAO_COLS) \
        .withColumn("cpf", C.strip_ws("cpf")).withColumn("_key", F.coalesce("id_vacinacao", -1 - F.col("req_seq")))
    old = state["vacinacao"].select(F.col("id_vacinacao").cast("bigint").alias("_key"), F.col("id_vacina").alias("_old_vac"),
                                    F.lit(True).alias("_old"))
    j = j.join(old, "_key", "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    j = exists_in(j, state["cidadao"], [("cpf", "cpf")], "_cit")
    j = j.join(state["vacina"].select("id_vacina", F.col("qtd_doses").alias("_stock")), "id_vacina", "left")
    j = exists_in(j, state["local"], [("id_local", "id_local")], "_fk_loc")
    j = exists_in(j, state["campanha"], [("id_campanha", "id_campanha")], "_fk_camp")
    early = [(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown_kind"),
             (put & missing("cpf", "text"), "missing_field"),
             (ins & any_of([missing(c, "int") for c in ("id_vacina", "id_local", "id_campanha")]), "missing_field")]
    if check_options:
        j = exists_in(j, offered_vacinas(state, as_of), [("id_vacina", "id_vacina")], "_op_vac")
        j = exists_in(j, offered_campanhas(state, as_of), [("id_campanha", "id_campanha")], "_op_camp")
        early.append((put & ~(F.col("_op_vac") & F.col("_op_camp") & F.col("_fk_loc")), "not_offered"))
    early += [(put & F.coalesce(F.col("contagem") < 1, F.lit(False)), "out_of_range"), (put & ~F.col("_cit"), "not_citizen")]
    late = [(put & too_long("vacinacao"), "too_long"), (put & not_null("vacinacao", ["contagem", "data_aplicacao"]), "not_null")]
    # An insert into an unknown lot runs out of stock; an update that stays in one breaks the key.
    fk = [(put & ~(F.col("_fk_loc") & F.col("_fk_camp") & (ins | F.col("_stock").isNotNull())), "fk_violation")]
    return j.select("req_seq", "kind", "_key", *VACINACAO_COLS, "_old", "_old_vac", "_stock", first_reason(early).alias("_pre"),
                    first_reason(late).alias("_post"), first_reason(fk).alias("_fk"))


def _round(ranked: DataFrame, block: int, doses_whole: bool, lots_whole: bool) -> DataFrame:
    """``ranked`` with what the requests find when ``_acc`` is who was accepted: ``_there`` and ``_short``."""
    ins, dele = F.col("kind") == INSERT, F.col("kind") == DELETE
    put = F.struct(F.when(~dele, F.col("id_vacina")).alias("lot"), (~dele).alias("there"))
    if doses_whole:
        now = ranked.withColumn("_seen", F.last(F.when(F.col("_acc"), put), ignorenulls=True).over(
            Window.partitionBy("_id").orderBy("req_seq").rowsBetween(Window.unboundedPreceding, -1)))
    else:
        now = serial.last_before(ranked, ["_id"], "req_seq", "_acc", put, "_seen", block)
    seen = F.col("_seen").isNotNull()
    now = now.withColumn("_there", ins | F.when(seen, F.col("_seen.there")).otherwise(F.col("_old"))) \
        .withColumn("_lot", F.when(seen, F.col("_seen.lot")).otherwise(F.col("_old_vac")))
    now = now.withColumn("_move", ~ins & ~dele & F.col("_there") & ~F.col("id_vacina").eqNullSafe(F.col("_lot")))
    asks = F.col("_reach") & (ins | F.col("_move"))
    gives = F.col("_acc") & ((dele & F.col("_there")) | F.col("_move"))
    # Each request has one row that goes on; one that asks for nothing waits in a group of its own.
    own = F.struct(F.when(asks, F.col("id_vacina")).alias("lot"), F.when(~asks, F.col("req_seq")).alias("alone"),
                   F.when(asks & F.col("_valid"), -1).otherwise(0).alias("delta"), F.lit(True).alias("main"))
    back = F.struct(F.col("_lot").alias("lot"), F.lit(None).cast("bigint").alias("alone"), F.lit(1).alias("delta"), F.lit(False).alias("main"))
    kept = [*ranked.columns, "_there"]
    now = now.withColumn("_asks", F.coalesce(asks, F.lit(False)))
    events = now.select(*kept, "_asks", F.explode(F.array_compact(F.array(own, F.when(gives, back)))).alias("e")).select(*kept, "_asks", "e.*")
    # A return's own stock is not asked for, so its row needs no opening stock.
    if lots_whole:
        line = Window.partitionBy("lot", "alone").orderBy("req_seq")
        before = Window.unboundedPreceding, -1
        walk = events.withColumn("_run", F.sum("delta").over(line.rowsBetween(Window.unboundedPreceding, 0))) \
            .withColumn("_low", F.min("_run").over(line.rowsBetween(*before)))
        left = F.col("_stock") + F.col("_run") - F.col("delta")
        walk = walk.withColumn("_left", left - F.least(F.lit(0), F.col("_stock") + F.col("_low")))
    else:
        walk = serial.stock_before(events, ["lot", "alone"], "req_seq", "delta", "_stock", "_left", block)
    short = F.col("_asks") & (F.col("_stock").isNull() | (F.col("_stock") < 0) | (F.col("_left") < 1))
    return walk.where("main").select(*kept, F.coalesce(short, F.lit(False)).alias("_short"))


def _in_order(j: DataFrame, base: int, materialize: bool, block: int) -> DataFrame:
    """(req_seq, _id, reason): the outcome of requests that come one by one; ``_id`` is the dose a request is about.

    Each round takes the last round's accepted requests for true. From them
    follow the ids of the inserted doses, for every dose whether it is there and
    in which lot, and for every lot the walk through its takes and returns.
    What a request gets depends on earlier ones alone, so a round that
    changes nothing has the one-by-one outcome; the rounds follow the longest
    chain from dose to lot to dose.

    The rounds hold only requests that may be accepted: those that another check
    refuses, that ask an unknown lot or name a dose that there cannot be neither
    take nor give; what they find is looked up once, with the rounds' outcome.
    The ids of inserted doses matter in the rounds only if a request names one.
    Groups of at most ``block`` rows go through one window, others in blocks.
    """
    ins = F.col("kind") == INSERT
    reach = F.col("_pre").isNull() & F.col("_post").isNull()
    j = j.select("req_seq", "kind", "_key", "id_vacina", "_old", "_old_vac", "_stock", "_pre", "_post", "_fk",
                 reach.alias("_reach"), (reach & F.col("_fk").isNull()).alias("_valid"))
    slim = ["req_seq", "kind", "_key", "id_vacina", "_old", "_old_vac", "_stock", "_reach", "_valid"]
    inserts = j.where(F.col("_valid") & ins).count()
    given = ~ins & F.col("_key").between(base + 1, base + inserts)
    named = not j.where(given).isEmpty()
    stocked = F.col("_stock").isNotNull() & (F.col("_stock") >= 0)
    may = F.col("_valid") & F.when(ins, stocked).otherwise(F.col("_old") | given)
    held = _maybe_cut(j.where(may).select(*slim, F.lit(True).alias("_acc")), materialize)

    def ranked(rows: DataFrame) -> DataFrame:
        if not named:
            return rows.withColumn("_id", F.col("_key"))
        rows = serial.prefix_count(rows, [], "req_seq", F.col("_acc") & ins, "_rank", block)
        return rows.withColumn("_id", F.when(ins & F.col("_acc"), F.lit(base) + F.col("_rank") + 1).otherwise(F.col("_key"))).drop("_rank")

    def sizes(rows: DataFrame) -> tuple[bool, bool]:
        """Whether all requests of a dose, and all takes and returns of a lot, are at most ``block``."""
        dose = rows.groupBy("_key").count().where(F.col("count") >= block)
        # A lot gets back what it gave and the doses it had.
        rows = rows.where("_reach")
        lots = rows.where(F.col("kind") != DELETE).select("id_vacina", F.lit(2).alias("n")).unionAll(
            rows.where("_old_vac is not null").select(F.col("_old_vac").alias("id_vacina"), F.lit(1).alias("n")))
        lot = lots.groupBy("id_vacina").agg(F.sum("n").alias("n")).where(F.col("n") > block)
        return dose.isEmpty(), lot.isEmpty()

    whole = sizes(held)
    while True:
        now = _round(ranked(held), block, *whole)
        now = _maybe_cut(now.select(*slim, "_acc", (F.col("_valid") & F.col("_there") & ~F.col("_short")).alias("_now")), materialize)
        if now.where("_now <> _acc").isEmpty():
            break
        held = now.select(*slim, F.col("_now").alias("_acc"))
    # The whole batch once, with the outcome: who was accepted, then the ids, doses and lots that all requests find.
    accepted = now.where("_now").select("req_seq", F.lit(True).alias("_acc"))
    every = _maybe_cut(j.join(accepted, "req_seq", "left").withColumn("_acc", F.coalesce("_acc", F.lit(False))), materialize)
    every = serial.prefix_count(every.where(F.col("_acc") & ins), [], "req_seq", F.lit(True), "_rank", block) \
        .withColumn("_id", F.lit(base) + F.col("_rank") + 1).drop("_rank") \
        .unionAll(every.where(~(F.col("_acc") & F.coalesce(ins, F.lit(False)))).withColumn("_id", F.col("_key")))
    found = _round(_maybe_cut(every, materialize), block, *sizes(every))
    reason = F.coalesce("_pre", F.when(~F.col("_there"), F.lit("no_match")), "_post", F.when(F.col("_short"), F.lit("no_stock")), "_fk")
    return found.select("req_seq", "_id", reason.alias("reason"))


def apply_vacinacao_changes(state: State, requests: DataFrame, check_options: bool = False, as_of=None, materialize: bool = True,
                            block: int = serial.DEFAULT_BLOCK, id_base: int | None = None):
    """C19, C20 and C21 with W1, W2 and K5 in one order: ``(new_state, decisions)``.

    ``requests``: req_seq, kind (``insert``, ``update``, ``delete``; anything else
    is refused as ``unknown_kind``), id_vacinacao (ignored for inserts) and the
    six columns of a dose (ignored for deletes); further columns are ignored.
    The checks of each kind and their order are those of its own operator. The
    outcome is that of requests that come one by one, also where a request
    names the id that the batch itself gives to a dose. Ids go on behind
    ``id_base`` or the table's largest; an id that was deleted does not come
    back. A lot whose opening stock is below 0 gives nothing in the batch.

    ``state["vacinacao"]`` and ``state["vacina"]`` may be the parts of those
    tables that hold the doses and lots in question, if ``id_base`` is given.
    """
    table = state["vacinacao"]
    if id_base is None:
        id_base = int(table.agg(F.max("id_vacinacao")).first()[0] or 0)
    j = _maybe_cut(_judge_alone(state, requests, check_options, as_of), materialize)
    j = _maybe_cut(j.join(_in_order(j, id_base, materialize, block), "req_seq"), materialize)
    ok = j.where(F.col("reason").isNull())
    last = serial.last_per_key(ok.select("req_seq", "_id", "kind", "_old_vac", *VACINACAO_COLS), ["_id"], "req_seq") \
        .withColumn("id_vacinacao", F.col("_id"))
    left = last.where(F.col("kind") != DELETE)
    new_table = table.join(last.select("id_vacinacao"), "id_vacinacao", "left_anti").select(*table.columns) \
        .unionByName(_with_ids(table, left, "id_vacinacao"))
    # Per dose only the opening and the closing lot count.
    delta = last.where(F.col("_old_vac").isNotNull()).select(F.col("_old_vac").alias("id_vacina"), F.lit(1).alias("_d")) \
        .unionByName(left.select("id_vacina", F.lit(-1).alias("_d")))
    j = j.withColumn("_new", F.when(F.col("reason").isNull() & (F.col("kind") == INSERT), F.col("_id")))
    return {"vacinacao": new_table, "vacina": stock_after(state["vacina"], delta)}, decisions(j, "_new")
