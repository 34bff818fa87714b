"""Change operators against loops that handle one request at a time, on random batches over the seed rows.

Every form check is written here as the form does it, on plain Python values;
requests of one batch see the opening tables, except where an operator counts
earlier requests (first wins, stock, seats, ids).
"""

import datetime as dt
import random

import pytest

from imunis.operators import changes as ch
from imunis.sources.schemas import TABLES

from seed import ROWS, tables

COLS = {n: [f.name for f in s.schema.fields] for n, s in TABLES.items()}
DAYS = [dt.date(2031, 3, d) for d in (1, 5, 11, 12, 13, 14)] + [None]
CPFS = [r[0] for r in ROWS["usuario"]] + ["79999999999", "", "  ", None, " 70000000001 ", "7" * 25]
TEXTS = ["x", "", None, "y" * 101, "Sala", "z", "w"]


def dicts(table):
    return [dict(zip(COLS[table], r)) for r in ROWS[table]]


def strip(s):
    return s.strip() if s is not None else None


def too_long(table, r, cols=None):
    return any(r[c] is not None and len(r[c]) > n for c, n in TABLES[table].lengths.items() if cols is None or c in cols)


def null(table, r, skip):
    return any(r[c] is None for c in TABLES[table].not_null if c != skip)


def first(*checks):
    return next((code for bad, code in checks if bad), None)


def has(table, **key):
    return any(all(row[c] == v for c, v in key.items()) for row in dicts(table))


def form(table, r):
    """What the form itself refuses."""
    if table == "vacina":
        lot = r["codigo_lote"]
        return first((any(not r[c] for c in ("nome", "doenca_alvo", "codigo_lote", "data_chegada", "data_validade"))
                      or (lot.isdigit() and int(lot) == 0), "missing_field"),
                     ((r["qtd_doses"] is not None and r["qtd_doses"] < 0) or not lot.isdigit(), "out_of_range"),
                     (r["data_chegada"] and r["data_validade"] and r["data_validade"] <= r["data_chegada"], "bad_dates")) \
            if lot is not None else "missing_field"
    if table == "campanha":
        return first((any(not r[c] for c in ("nome", "doenca_alvo", "data_inicio", "publico_alvo")), "missing_field"),
                     (r["data_fim"] and r["data_inicio"] and r["data_fim"] < r["data_inicio"], "bad_dates"))
    return first((any(not r[c] for c in ("nome", "rua", "bairro", "numero", "cidade", "estado", "contato")), "missing_field"),
                 (r["numero"] is not None and r["numero"] < 1 or r["estado"] is not None and len(r["estado"]) > 2, "out_of_range"))


VALUES = {
    "vacina": {"nome": TEXTS, "doenca_alvo": ["a", "b"], "codigo_lote": ["12", "0", "00", "x1", "", None, "7"], "data_chegada": DAYS,
               "data_validade": DAYS, "qtd_doses": [-1, 0, 5, None]},
    "campanha": {"nome": TEXTS, "doenca_alvo": ["a", "b"], "tipo_vacina": ["Dose Única", None, "z" * 31], "data_inicio": DAYS,
                 "data_fim": DAYS, "publico_alvo": ["p", "", "geral"]},
    "local": {"nome": TEXTS, "rua": ["r"], "bairro": ["b"], "numero": [0, 3, -2, None], "cidade": ["c"], "estado": ["SP", "RJX"],
              "contato": ["1", ""], "capacidade": [-1, 0, 4, None]},
}


def batch(rnd, values, n=30):
    return [{"req_seq": s, **{c: rnd.choice(v) for c, v in values.items()}} for s in rnd.sample(range(1, 400), n)]


def frame(spark, reqs, table, extra=()):
    fields = ["req_seq long"] + [f"{f.name} {f.dataType.simpleString()}" for f in TABLES[table].schema.fields if f.name in reqs[0]]
    names = [f.split()[0] for f in fields] + [e.split()[0] for e in extra]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in reqs], ", ".join(fields + list(extra)))


def reasons(dec):
    return {r["req_seq"]: r["reason"] for r in dec.collect()}


def stored(df, table):
    return sorted((tuple(r[c] for c in COLS[table]) for r in df.collect()), key=str)


def after_insert(table, key, reqs, want, write=lambda r: r):
    rows, at = list(ROWS[table]), max(r[0] for r in ROWS[table])
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        if want[r["req_seq"]] is None:
            at += 1
            rows.append(tuple(at if c == key else write(r)[c] for c in COLS[table]))
    return sorted(rows, key=str)


def after_update(table, key, reqs, want, cols, write=lambda r: r):
    rows = {r[key]: r for r in dicts(table)}
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        if want[r["req_seq"]] is None:
            rows[r[key]].update({c: write(r)[c] for c in cols})
    return sorted((tuple(r[c] for c in COLS[table]) for r in rows.values()), key=str)


def positive(r):
    return {**r, "capacidade": r["capacidade"] if (r["capacidade"] or 0) > 0 else None}


@pytest.mark.parametrize("table", ["vacina", "campanha", "local"])
def test_single_table_inserts_and_updates(spark, table):
    t, rnd, key = tables(spark), random.Random(table), TABLES[table].key[0]
    write = positive if table == "local" else (lambda r: r)
    reqs = batch(rnd, VALUES[table], 200)
    want = {r["req_seq"]: form(table, r) or first((too_long(table, r), "too_long"), (null(table, r, key), "not_null")) for r in reqs}
    new, dec = getattr(ch, f"apply_{table}_insert")(t, frame(spark, reqs, table))
    assert reasons(dec) == want
    assert stored(new[table], table) == after_insert(table, key, reqs, want, write)

    reqs = batch(rnd, {key: [1, 2, 99], **VALUES[table]}, 200)
    want = {r["req_seq"]: form(table, r) or first((not has(table, **{key: r[key]}), "no_match"), (too_long(table, r), "too_long"),
                                                   (null(table, r, key), "not_null")) for r in reqs}
    assert {"no_match", None} <= set(want.values())
    new, dec = getattr(ch, f"apply_{table}_update")(t, frame(spark, reqs, table))
    assert reasons(dec) == want
    assert stored(new[table], table) == after_update(table, key, reqs, want, [c for c in COLS[table] if c != key], write)


DELETES = {
    "vacina": [("vacinacao", "id_vacina", "in_use"), ("agendamento", "id_vacina", "fk_violation")],
    "campanha": [("vacinacao", "id_campanha", "in_use")],
    "local": [("vacinacao", "id_local", "in_use"), ("agendamento", "id_local", "in_use")],
    "parente": [], "agendamento": [], "vacinacao": [],
    "usuario": [("vacinacao", "cpf", "in_use"), ("agendamento", "cpf", "fk_violation"), ("parente", "cpf_responsavel", "fk_violation"),
                ("parente", "cpf_parente", "fk_violation")],
}


@pytest.mark.parametrize("table", sorted(DELETES))
def test_deletes(spark, table):
    t, rnd, key = tables(spark), random.Random(table), TABLES[table].key[0]
    ids = [r[0] for r in ROWS[table]] + (["79999999999"] if table == "usuario" else [99])
    reqs = batch(rnd, {key: ids}, 20)
    gone, want = set(), {}
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        v = r[key]
        reason = "no_match" if v in gone or not has(table, **{key: v}) else first(
            *[(has(child, **{c: v}), code) for child, c, code in DELETES[table]])
        want[r["req_seq"]] = reason
        if reason is None:
            gone.add(v)
    new, dec = getattr(ch, f"apply_{table}_delete")(t, frame(spark, reqs, table))
    assert reasons(dec) == want
    assert stored(new[table], table) == sorted((r for r in ROWS[table] if r[0] not in gone), key=str)
    if table == "vacinacao":
        back = [r[3] for r in ROWS[table] if r[0] in gone]
        assert {r["id_vacina"]: r["qtd_doses"] for r in new["vacina"].collect()} == \
            {r[0]: r[6] + back.count(r[0]) for r in ROWS["vacina"]}
    if table == "usuario":
        for role in ("cidadao", "administrador", "agente_saude"):
            assert {r["cpf"] for r in new[role].collect()} == {r[0] for r in ROWS[role]} - gone


@pytest.mark.parametrize("options", [False, True])
def test_links(spark, options):
    t, rnd = tables(spark), random.Random(21)
    reqs = batch(rnd, {"cpf_responsavel": CPFS, "cpf_parente": CPFS}, 60)

    def form_of(r):
        nobody = not (has("cidadao", cpf=r["cpf_responsavel"]) and has("cidadao", cpf=r["cpf_parente"]))
        return first((not r["cpf_responsavel"] or not r["cpf_parente"], "missing_field"), (options and nobody, "not_offered"),
                     (r["cpf_responsavel"] == r["cpf_parente"], "self_link")), nobody

    made, want = {r[1:] for r in ROWS["parente"]}, {}
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        pair = (r["cpf_responsavel"], r["cpf_parente"])
        reason, nobody = form_of(r)
        want[r["req_seq"]] = reason = reason or first((pair in made, "duplicate"), (too_long("parente", r), "too_long"),
                                                      (nobody, "fk_violation"))
        if reason is None:
            made.add(pair)
    new, dec = ch.apply_parente_insert(t, frame(spark, reqs, "parente"), check_options=options)
    assert reasons(dec) == want
    assert stored(new["parente"], "parente") == after_insert("parente", "id_parentesco", reqs, want)

    reqs = batch(rnd, {"id_parentesco": [1, 2, 3, 99], "cpf_responsavel": CPFS, "cpf_parente": CPFS}, 60)
    want = {}
    for r in reqs:
        reason, nobody = form_of(r)
        want[r["req_seq"]] = reason or first((not has("parente", id_parentesco=r["id_parentesco"]), "no_match"),
                                             (too_long("parente", r), "too_long"), (nobody, "fk_violation"))
    new, dec = ch.apply_parente_update(t, frame(spark, reqs, "parente"), check_options=options)
    assert reasons(dec) == want
    assert stored(new["parente"], "parente") == after_update("parente", "id_parentesco", reqs, want, ["cpf_responsavel", "cpf_parente"])


AS_OF = dt.date(2031, 4, 15)
BOOKING = {"cpf": CPFS, "id_campanha": [1, 2, 3, 0, None], "id_vacina": [1, 2, 3, 4, 9], "id_local": [1, 2, 7], "data_agendamento": DAYS}


def offered(r):
    lots = {x["id_vacina"] for x in dicts("vacina") if x["data_validade"] >= AS_OF}
    camps = {x["id_campanha"] for x in dicts("campanha") if x["data_inicio"] <= AS_OF and (x["data_fim"] or AS_OF) >= AS_OF}
    return r["id_vacina"] in lots and r["id_campanha"] in camps and has("local", id_local=r["id_local"])


@pytest.mark.parametrize("options, strict", [(False, False), (True, False), (False, True)])
def test_appointments(spark, options, strict):
    t, rnd = tables(spark), random.Random(31)
    reqs = batch(rnd, BOOKING, 80)
    for r in reqs[:30]:
        r["cpf"], r["id_local"], r["id_campanha"] = rnd.choice(CPFS[:4]), 1, 1

    def form_of(r):
        return first((not r["cpf"] or not r["id_campanha"] or not r["id_vacina"] or not r["id_local"] or not r["data_agendamento"],
                      "missing_field"), (options and not offered(r), "not_offered"))

    def keys(r):
        return not (has("cidadao", cpf=strip(r["cpf"])) and has("vacina", id_vacina=r["id_vacina"]) and has("local", id_local=r["id_local"]))

    def write(r):
        return {**r, "cpf": strip(r["cpf"])}

    taken = {(r[4], r[2], r[1]) for r in ROWS["agendamento"]}
    seats = {}
    for r in ROWS["agendamento"]:
        seats[r[3], r[1]] = seats.get((r[3], r[1]), 0) + 1
    room = {r[0]: r[8] or 0 for r in ROWS["local"]}
    booked, want = set(taken), {}
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        w = write(r)
        dup_key, slot = (w["cpf"], r["id_vacina"], r["data_agendamento"]), (r["id_local"], r["data_agendamento"])
        valid = form_of(r) is None and not too_long("agendamento", w) and not keys(r)
        dup = dup_key in booked
        full = seats.get(slot, 0) >= room.get(r["id_local"], 0)
        want[r["req_seq"]] = form_of(r) or first((too_long("agendamento", w), "too_long"), (strict and dup, "duplicate"),
                                                 (strict and full, "full"), (keys(r), "fk_violation"))
        if strict and valid and not dup and not full:  # only what is accepted books
            booked.add(dup_key)
            seats[slot] = seats.get(slot, 0) + 1
    new, dec = ch.apply_agendamento_insert(t, frame(spark, reqs, "agendamento", ["id_campanha int"]), strict=strict,
                                           check_options=options, as_of=AS_OF)
    assert reasons(dec) == want
    assert stored(new["agendamento"], "agendamento") == after_insert("agendamento", "id_agendamento", reqs, want, write)
    if strict:
        return
    reqs = batch(rnd, {"id_agendamento": [1, 2, 3, 4, 99], **BOOKING}, 80)
    want = {r["req_seq"]: form_of(r) or first((not has("agendamento", id_agendamento=r["id_agendamento"]), "no_match"),
                                              (too_long("agendamento", write(r)), "too_long"), (keys(r), "fk_violation")) for r in reqs}
    new, dec = ch.apply_agendamento_update(t, frame(spark, reqs, "agendamento", ["id_campanha int"]), check_options=options, as_of=AS_OF)
    assert reasons(dec) == want
    assert stored(new["agendamento"], "agendamento") == after_update(
        "agendamento", "id_agendamento", reqs, want, [c for c in COLS["agendamento"] if c != "id_agendamento"], write)


@pytest.mark.parametrize("options", [False, True])
def test_dose_updates(spark, options):
    t, rnd = tables(spark), random.Random(41)
    reqs = batch(rnd, {"id_vacinacao": [1, 2, 3, 99], "contagem": [0, 1, 2, None], "data_aplicacao": DAYS, "id_vacina": [1, 2, 3, 4, 9],
                       "cpf": CPFS, "id_local": [1, 2, 7], "id_campanha": [1, 2, 9]}, 80)
    for r in reqs[:40]:
        r.update(cpf="70000000001", contagem=1, id_local=1, id_campanha=1, data_aplicacao=DAYS[0])
    old = {r[0]: r[3] for r in ROWS["vacinacao"]}
    stock = {r[0]: r[6] for r in ROWS["vacina"]}
    want, final = {}, dict(old)
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        cpf, lot = strip(r["cpf"]), r["id_vacina"]
        w = {**r, "cpf": cpf}
        before = first((not cpf, "missing_field"), (options and not offered(r), "not_offered"),
                       (r["contagem"] is not None and r["contagem"] < 1, "out_of_range"), (not has("cidadao", cpf=cpf), "not_citizen"),
                       (r["id_vacinacao"] not in old, "no_match"), (too_long("vacinacao", w), "too_long"),
                       (r["contagem"] is None or r["data_aplicacao"] is None, "not_null"))
        move = before is None and final[r["id_vacinacao"]] != lot
        keys = not (has("local", id_local=r["id_local"]) and has("campanha", id_campanha=r["id_campanha"]) and lot in stock)
        want[r["req_seq"]] = reason = before or first((move and stock.get(lot, 0) < 1, "no_stock"), (keys, "fk_violation"))
        if reason is None and move:  # one by one: the dose of the lot it has by now goes back
            stock[final[r["id_vacinacao"]]] += 1
            stock[lot] -= 1
            final[r["id_vacinacao"]] = lot
    new, dec = ch.apply_vacinacao_update(t, frame(spark, reqs, "vacinacao"), check_options=options, as_of=AS_OF, block=8)
    assert reasons(dec) == want
    assert {r["id_vacina"]: r["qtd_doses"] for r in new["vacina"].collect()} == stock
    assert stored(new["vacinacao"], "vacinacao") == after_update(
        "vacinacao", "id_vacinacao", reqs, want, [c for c in COLS["vacinacao"] if c != "id_vacinacao"], lambda r: {**r, "cpf": strip(r["cpf"])})


ROLE = {"Cidadão": "cidadao", "Administrador": "administrador", "Agente de Saúde": "agente_saude"}
PERSON = {"nome": TEXTS, "telefone": ["1", "", None], "tipo_usuario": list(ROLE), "cartao_sus": ["9", None, "9" * 101], "rua": [None],
          "bairro": ["b"], "numero": [4], "cidade": ["c"], "estado": ["SP"], "local_trabalho": ["l", None], "email": ["e", None],
          "posto_trabalho": ["p"]}
EXTRA = [f"{c} {'int' if c == 'numero' else 'string'}" for c in PERSON if c not in ("nome", "telefone")]


def role_row(r, cpf):
    table = ROLE[r["tipo_usuario"]]
    row = {**r, "cpf": cpf}
    return table, row, too_long(table, row), null(table, row, "cpf") if table != "cidadao" else False


def test_users_insert(spark):
    t, rnd = tables(spark), random.Random(51)
    reqs = batch(rnd, {"cpf": CPFS + ["71111111111", "72222222222 "], **PERSON}, 80)
    taken, want = {r[0] for r in ROWS["usuario"]}, {}
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        cpf = strip(r["cpf"])
        table, row, long, nul = role_row(r, cpf)
        want[r["req_seq"]] = reason = first((not cpf or not r["nome"] or not r["telefone"], "missing_field"),
                                            (too_long("usuario", row) or long, "too_long"), (nul, "not_null"), (cpf in taken, "duplicate"))
        if reason is None:
            taken.add(cpf)
    new, dec = ch.apply_usuario_insert(t, frame(spark, reqs, "usuario", EXTRA))
    assert reasons(dec) == want and None in want.values()
    assert {r["cpf"] for r in new["usuario"].collect()} == taken


@pytest.mark.parametrize("block", [2, 512])
def test_users_update(spark, block, monkeypatch):
    monkeypatch.setattr(ch.serial.scan_states, "__defaults__", (block,))
    t, rnd = tables(spark), random.Random(61)
    reqs = batch(rnd, {"cpf": [r[0] for r in ROWS["usuario"]] + ["79999999999"], **PERSON}, 160)
    for r in reqs:
        r["cpf_digitado"] = rnd.choice([r["cpf"], f" {r['cpf']} ", r["cpf"], None, "other"])
    roles = {u[0]: {table: row for table in ROLE.values() for row in dicts(table) if row["cpf"] == u[0]} for u in ROWS["usuario"]}
    refs = {r[4] for r in ROWS["vacinacao"]} | {r[4] for r in ROWS["agendamento"]} | {c for r in ROWS["parente"] for c in r[1:]}
    want, names = {}, {u[0]: u[1] for u in ROWS["usuario"]}
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        table, row, long, nul = role_row(r, r["cpf"])
        mine = roles.get(r["cpf"])
        now = next((t for t in ROLE.values() if t in (mine or ())), None)
        change = table != now
        want[r["req_seq"]] = reason = first(
            (strip(r["cpf_digitado"]) != r["cpf"], "key_change"), (mine is None, "no_match"),
            (too_long("usuario", row) or long, "too_long"), (r["nome"] is None or r["telefone"] is None or nul, "not_null"),
            (change and now == "cidadao" and r["cpf"] in refs, "fk_violation"), (change and table in (mine or ()), "duplicate"))
        if reason is None:  # one by one
            names[r["cpf"]] = r["nome"]
            if change and now:
                del mine[now]
            mine[table] = {c: row[c] for c in COLS[table]}
    new, dec = ch.apply_usuario_update(t, frame(spark, reqs, "usuario", EXTRA + ["cpf_digitado string"]))
    assert reasons(dec) == want
    for table in ROLE.values():
        assert stored(new[table], table) == sorted((tuple(m[table][c] for c in COLS[table]) for m in roles.values() if table in m), key=str)
    assert {r["cpf"]: r["nome"] for r in new["usuario"].collect()} == names


@pytest.mark.parametrize("copies", [1, 2])
def test_appointment_rounds_move_few_rows(spark, monkeypatch, copies):
    """Keys asked for at several full sites, as a loop decides; rounds keep only requests that may get a seat."""
    t, rnd, sites = tables(spark), random.Random(71), range(1, 5)
    t["local"] = spark.createDataFrame([(i, "n", "r", "b", 1, "c", "PC", "x", 1 + i % 3) for i in sites], TABLES["local"].schema)
    citizens = [r[0] for r in ROWS["cidadao"]]
    reqs = [{"req_seq": s, "cpf": rnd.choice(citizens), "id_campanha": 1, "id_vacina": rnd.choice([1, 2, 3, 4]), "id_local": rnd.choice(sites),
             "data_agendamento": dt.date(2031, 5, rnd.randint(1, 3))} for s in rnd.sample(range(10 ** 6), 600)]
    booked, seats, want = set(), {}, []
    for r in sorted(reqs, key=lambda r: r["req_seq"]):
        key, slot = (r["cpf"], r["id_vacina"], r["data_agendamento"]), (r["id_local"], r["data_agendamento"])
        for reason in [None] * copies:  # equal rows are no duplicates of one another, but each takes a seat
            if key in booked and r["req_seq"] not in booked:
                reason = "duplicate"
            elif seats.get(slot, 0) >= 1 + r["id_local"] % 3:
                reason = "full"
            else:
                booked |= {key, r["req_seq"]}
                seats[slot] = seats.get(slot, 0) + 1
            want.append((r["req_seq"], str(reason)))
    kept = []
    monkeypatch.setattr(ch, "cut_lineage", lambda df, real=ch.cut_lineage: kept.append(real(df)) or kept[-1])
    batch_ = frame(spark, reqs * copies, "agendamento", ["id_campanha int"]).repartition(4)
    _, dec = ch.apply_agendamento_insert(t, batch_, strict=True)
    assert sorted((r["req_seq"], str(r["reason"])) for r in dec.collect()) == sorted(want)
    assert {reason for _, reason in want} == {"None", "duplicate", "full"}
    assert sum(df.count() > len(reqs) * copies / 2 for df in kept) <= 3  # the judged batch, its reasons, its ids


def test_role_tables_take_one_join_each(spark):
    """The batch is gathered once to a row for each user; a task then sorts no more than that and the table."""
    t, rnd = tables(spark), random.Random(73)
    reqs = batch(rnd, {"cpf": [r[0] for r in ROWS["usuario"]], **PERSON}, 60)
    for r in reqs:
        r["cpf_digitado"] = r["cpf"]
    new, _ = ch.apply_usuario_update(t, frame(spark, reqs, "usuario", EXTRA + ["cpf_digitado string"]))
    for table in ("usuario", *ROLE.values()):
        plan = new[table]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") <= 1 and "Aggregate" not in plan, plan
