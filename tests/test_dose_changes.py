"""Batches of dose inserts, updates and deletes against a loop that handles one request at a time."""

import random

import pytest
from pyspark.sql import functions as F

from imunis.operators import changes as ch
from imunis.operators import dose_changes as dc
from imunis.sources.schemas import TABLES

from seed import ROWS, tables
from test_loops import AS_OF, COLS, CPFS, DAYS, batch, first, has, offered, stored, strip, too_long

SCHEMA = "req_seq long, kind string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["vacinacao"].schema.fields)


def frame(spark, reqs):
    names = ["req_seq", "kind", *COLS["vacinacao"]]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in reqs], SCHEMA)


def serial_outcome(reqs, options=False, rows=None, stock=None):
    """(req_seq -> (reason, new id), doses by id, stock by lot), one request after the other."""
    doses = {r[0]: dict(zip(COLS["vacinacao"], r)) for r in (ROWS["vacinacao"] if rows is None else rows)}
    stock = {r[0]: r[6] for r in ROWS["vacina"]} if stock is None else dict(stock)
    top, out = max(doses, default=0), {}
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        kind, lot, w, new = r["kind"], r["id_vacina"], {**r, "cpf": strip(r["cpf"])}, None
        dose = doses.get(r["id_vacinacao"])
        lacks = r["contagem"] is None or r["data_aplicacao"] is None
        keys = has("local", id_local=r["id_local"]) and has("campanha", id_campanha=r["id_campanha"])
        out_of_range = (r["contagem"] is not None and r["contagem"] < 1, "out_of_range")
        citizen = (not has("cidadao", cpf=w["cpf"]), "not_citizen")
        if kind == "insert":
            reason = first((not w["cpf"] or not lot or not r["id_local"] or not r["id_campanha"], "missing_field"),
                           (options and not offered(r), "not_offered"), out_of_range, citizen, (too_long("vacinacao", w), "too_long"),
                           (lacks, "not_null"), (stock.get(lot, 0) < 1, "no_stock"), (not keys, "fk_violation"))
            if reason is None:
                top += 1
                new = top
                doses[new] = {**{c: w[c] for c in COLS["vacinacao"]}, "id_vacinacao": new}
                stock[lot] -= 1
        elif kind == "update":
            reason = first((not w["cpf"], "missing_field"), (options and not offered(r), "not_offered"), out_of_range, citizen,
                           (dose is None, "no_match"), (too_long("vacinacao", w), "too_long"), (lacks, "not_null"))
            move = reason is None and dose["id_vacina"] != lot
            reason = reason or first((move and stock.get(lot, 0) < 1, "no_stock"), (not keys or lot not in stock, "fk_violation"))
            if reason is None:
                if move:
                    stock[dose["id_vacina"]] += 1
                    stock[lot] -= 1
                dose.update({c: w[c] for c in COLS["vacinacao"] if c != "id_vacinacao"})
        elif kind == "delete":
            reason = None if dose else "no_match"
            if dose:
                stock[dose["id_vacina"]] += 1
                del doses[r["id_vacinacao"]]
        else:
            reason = "unknown_kind"
        out[r["req_seq"]] = (reason, new)
    return out, sorted((tuple(d[c] for c in COLS["vacinacao"]) for d in doses.values()), key=str), stock


def compare(state, frame_, want, **kw):
    new, dec = dc.apply_vacinacao_changes(state, frame_, **kw)
    rows = dec.collect()
    assert {r["req_seq"]: (r["reason"], r["new_id"]) for r in rows} == want[0] and len(rows) == len(want[0])
    assert all(r["accepted"] == (r["reason"] in (None, "no_match")) for r in rows)
    assert stored(new["vacinacao"], "vacinacao") == want[1]
    assert {r["id_vacina"]: r["qtd_doses"] for r in new["vacina"].collect()} == want[2]
    return new


VALUES = {"kind": ["insert", "insert", "update", "update", "delete", "delete", "upsert", None],
          "id_vacinacao": [1, 2, 3, 4, 5, 6, 7, 8, 99, None], "contagem": [1, 2], "data_aplicacao": DAYS[:3], "id_vacina": [1, 2, 3, 4],
          "cpf": ["70000000001"], "id_local": [1, 2], "id_campanha": [1, 2]}


@pytest.mark.parametrize("seed, block", [(1, 8), (3, 1 << 20)])
def test_mixed_batches_equal_one_by_one(spark, seed, block):
    """Mostly good requests, many on doses that the batch itself inserts, over lots with little stock."""
    t, rnd = tables(spark), random.Random(seed)
    t["vacina"] = t["vacina"].withColumn("qtd_doses", F.expr("cast(id_vacina % 3 as int)"))
    reqs = batch(rnd, VALUES, 90)
    stock = {r[0]: r[0] % 3 for r in ROWS["vacina"]}
    want = serial_outcome(reqs, stock=stock)
    told = {reason for reason, _ in want[0].values()}
    assert {None, "no_match", "no_stock", "unknown_kind"} <= told
    compare(t, frame(spark, reqs), want, block=block)


@pytest.mark.parametrize("options", [False, True])
def test_every_check_in_its_order(spark, options):
    t, rnd = tables(spark), random.Random(17)
    reqs = batch(rnd, {**VALUES, "contagem": [0, 1, 2, None], "data_aplicacao": DAYS, "id_vacina": [0, 1, 2, 3, 4, 9, None], "cpf": CPFS,
                       "id_local": [0, 1, 2, 7, None], "id_campanha": [1, 2, 9, None]}, 100)
    for r in reqs[:40]:
        r.update(cpf="70000000001", contagem=1, id_local=1, id_campanha=1, data_aplicacao=DAYS[0])
    compare(t, frame(spark, reqs), serial_outcome(reqs, options), check_options=options, as_of=AS_OF, block=64)


def test_one_kind_equals_its_own_operator(spark):
    t, rnd = tables(spark), random.Random(23)
    reqs = batch(rnd, VALUES, 25)
    for kind, apply in (("insert", ch.apply_vacinacao_insert), ("update", ch.apply_vacinacao_update), ("delete", ch.apply_vacinacao_delete)):
        f = frame(spark, [{**r, "kind": kind} for r in reqs])
        own = f.drop("kind", "id_vacinacao") if kind == "insert" else f.drop("kind") if kind == "update" else f.select("req_seq", "id_vacinacao")
        mixed, dec = dc.apply_vacinacao_changes(t, f)
        alone, dec1 = apply(t, own)
        assert sorted(dec.collect()) == sorted(dec1.collect())
        for name in ("vacinacao", "vacina"):
            assert stored(mixed[name], name) == stored(alone[name], name)


def test_empty_batch_empty_tables_and_other_columns(spark):
    t = tables(spark)
    none = frame(spark, [{"req_seq": 1, "kind": "insert", **dict(zip(COLS["vacinacao"], [None] * 7))}])
    new = compare(t, none.where("false"), serial_outcome([]))
    assert new["vacinacao"].count() == len(ROWS["vacinacao"])
    bare = {**t, "vacinacao": t["vacinacao"].where("false")}
    reqs = [{"req_seq": s, "kind": k, "id_vacinacao": i, "contagem": 1, "data_aplicacao": DAYS[0], "id_vacina": 1, "cpf": "70000000001",
             "id_local": 1, "id_campanha": 1} for s, k, i in [(5, "delete", 1), (7, "insert", 1), (8, "update", 1), (9, "delete", 1), (10, "insert", 1)]]
    f = frame(spark, reqs).withColumn("_id", F.lit(3)).withColumn("reason", F.lit("x")).withColumn("_stock", F.lit(0))
    compare(bare, f, serial_outcome(reqs, rows=[]))


def test_rounds_hold_only_requests_that_may_be_accepted(spark, monkeypatch):
    """A batch that is mostly refused for other reasons, and a chain of moves and inserts that takes several rounds."""
    t, rnd = tables(spark), random.Random(29)
    t["vacina"] = t["vacina"].withColumn("qtd_doses", F.expr("cast(id_vacina % 2 as int)"))
    reqs = batch(rnd, {**VALUES, "kind": ["insert", "update", "delete"], "id_vacinacao": [1, 2, 3, 50]}, 240)
    for r in reqs[:180]:
        r.update(kind=rnd.choice(["insert", "update"]), cpf=rnd.choice(["", "nobody"]))
    want = serial_outcome(reqs, stock={r[0]: r[0] % 2 for r in ROWS["vacina"]})
    kept = []

    def cut(df, materialize, real=dc._maybe_cut):
        kept.append(real(df, materialize))
        return kept[-1]
    monkeypatch.setattr(dc, "_maybe_cut", cut)
    compare(t, frame(spark, reqs), want)
    sizes = [df.count() for df in kept]
    assert sum(n > len(reqs) / 2 for n in sizes) <= 4  # judged alone, two steps to look the outcome up, the outcome
    assert len(sizes) > 6 and sizes[-1] == len(reqs)
