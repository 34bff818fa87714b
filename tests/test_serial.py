"""Serial rules as set operations, checked against brute force and against a
row-by-row loop that handles one request at a time like the reference."""

import random

from pyspark.sql import functions as F

from imunis.operators import changes as ch
from imunis.operators import serial
from imunis.sources.schemas import request_schema

from seed import tables


def test_prefix_count_matches_brute_force(spark):
    rnd = random.Random(7)
    data = [(i * 3 + rnd.randint(0, 2), rnd.choice([None, 1, 2, 3]), rnd.random() < 0.6) for i in range(300)]
    seen, uniq = set(), []
    for s, k, f in data:
        if s not in seen:
            seen.add(s)
            uniq.append((s, k, f))
    df = spark.createDataFrame(uniq, "seq long, k int, f boolean")
    for block in (4, 64, 1 << 20):
        got = {r["seq"]: r["n"] for r in serial.prefix_count(df, ["k"], "seq", "f", "n", block).collect()}
        for s, k, _ in uniq:
            want = sum(1 for s2, k2, f2 in uniq if k2 == k and s2 < s and f2)
            assert got[s] == want, (block, s)
        glob = {r["seq"]: r["n"] for r in serial.prefix_count(df, [], "seq", "f", "n", block).collect()}
        for s, _, _ in uniq:
            assert glob[s] == sum(1 for s2, _, f2 in uniq if s2 < s and f2)


def test_allocate_ids_dense(spark):
    table = spark.createDataFrame([(5,), (9,)], "id long")
    df = spark.createDataFrame([(10, True), (3, False), (7, True), (12, True)], "seq long, ok boolean")
    got = {r["seq"]: r["new_id"] for r in serial.allocate_ids(df, "ok", "seq", table, "id", block=2).collect()}
    assert got == {3: None, 7: 10, 10: 11, 12: 12}


def test_last_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "seq long, k int, v string")
    got = sorted((r["k"], r["v"]) for r in serial.last_per_key(df, ["k"], "seq").collect())
    assert got == [(1, "b"), (2, "c")]


def _loop_insert(state_rows, reqs):
    """Reference behaviour of the dose form, one request at a time."""
    stock = {r[0]: r[6] for r in state_rows["vacina"]}
    citizens = {r[0] for r in state_rows["cidadao"]}
    sites = {r[0] for r in state_rows["local"]}
    camps = {r[0] for r in state_rows["campanha"]}
    out = {}
    for seq, contagem, day, vac, cpf, loc, camp in sorted(reqs):
        cpf = (cpf or "").strip()
        if not cpf or not vac or not loc or not camp:
            out[seq] = "missing_field"
        elif cpf not in citizens:
            out[seq] = "not_citizen"
        elif vac not in stock or stock[vac] < 1:
            out[seq] = "no_stock"
        elif loc not in sites or camp not in camps:
            out[seq] = "fk_violation"
        else:
            out[seq] = None
            stock[vac] -= 1
    return out, stock


def test_vacinacao_insert_matches_loop(spark):
    from seed import ROWS
    t = tables(spark)
    rnd = random.Random(11)
    import datetime as dt
    cpfs = ["70000000001", " 70000000002 ", "70000000005", "", "70000000003"]
    for trial in range(3):
        reqs = [(seq, 1, dt.date(2031, 3, 11), rnd.choice([1, 1, 1, 2, 4, 7, 0]), rnd.choice(cpfs),
                 rnd.choice([1, 2, 3]), rnd.choice([1, 2, 5]))
                for seq in rnd.sample(range(1, 500), 40)]
        df = spark.createDataFrame(reqs, request_schema("vacinacao", with_key=False))
        new, dec = ch.apply_vacinacao_insert(t, df, block=8)
        want, stock = _loop_insert(ROWS, reqs)
        got = {r["req_seq"]: r["reason"] for r in dec.collect()}
        assert got == want
        assert {r["id_vacina"]: r["qtd_doses"] for r in new["vacina"].collect()} == stock
        ids = sorted(r["new_id"] for r in dec.where("accepted").collect())
        assert ids == list(range(4, 4 + len(ids)))


def test_vacinacao_update_never_oversells(spark):
    t = tables(spark)
    import datetime as dt
    reqs = [(10, 1, 1, dt.date(2031, 3, 11), 4, "70000000001", 1, 1),
            (11, 2, 1, dt.date(2031, 3, 11), 4, "70000000002", 1, 1),
            (12, 3, 1, dt.date(2031, 3, 11), 4, "70000000003", 1, 1),
            (13, 3, 1, dt.date(2031, 3, 11), 1, "70000000003", 1, 1),
            (14, 99, 1, dt.date(2031, 3, 11), 1, "70000000001", 1, 1)]
    df = spark.createDataFrame(reqs, "req_seq long, id_vacinacao long, contagem int, data_aplicacao date, "
                                     "id_vacina int, cpf string, id_local int, id_campanha int")
    new, dec = ch.apply_vacinacao_update(t, df)
    got = {r["req_seq"]: r["reason"] for r in dec.collect()}
    assert got == {10: None, 11: None, 12: None, 13: None, 14: "no_match"}
    stock = {r["id_vacina"]: r["qtd_doses"] for r in new["vacina"].collect()}
    # dose 2 moves lot 2 -> 4 (lot 2 +1, lot 4 -1); dose 1 moves 1 -> 4; dose 3 ends where it began
    assert stock == {1: 6, 2: 1, 3: 10, 4: 1}
    final = {r["id_vacinacao"]: r["id_vacina"] for r in new["vacinacao"].collect()}
    assert final == {1: 4, 2: 4, 3: 1}


def test_deletes_first_wins_and_cascade(spark):
    t = tables(spark)
    req = spark.createDataFrame([(1, "70000000005"), (2, "70000000005"), (3, "70000000001"), (4, "70000000004"),
                                 (5, "00000000000")], "req_seq long, cpf string")
    new, dec = ch.apply_usuario_delete(t, req)
    got = {r["req_seq"]: r["reason"] for r in dec.collect()}
    assert got == {1: None, 2: "no_match", 3: "in_use", 4: None, 5: "no_match"}
    assert new["administrador"].where(F.col("cpf") == "70000000004").count() == 0
    assert new["agente_saude"].count() == 0
    assert new["usuario"].count() == 4


def test_parente_insert_reverse_allowed(spark):
    t = tables(spark)
    req = spark.createDataFrame([(1, "70000000002", "70000000001"), (2, "70000000003", "70000000001"),
                                 (3, "70000000003", "70000000001"), (4, "70000000001", "70000000001"),
                                 (5, "70000000003", "70000000005")],
                                "req_seq long, cpf_responsavel string, cpf_parente string")
    new, dec = ch.apply_parente_insert(t, req)
    got = {r["req_seq"]: (r["reason"], r["new_id"]) for r in dec.collect()}
    assert got == {1: ("duplicate", None), 2: (None, 4), 3: ("duplicate", None), 4: ("self_link", None),
                   5: ("fk_violation", None)}
    assert new["parente"].count() == 4


def test_hot_key_is_spread_over_tasks(spark):
    """One key holding every row must not end up in one task: with small
    blocks its rows leave the running count in several partitions."""
    df = spark.range(0, 4000).select(F.col("id").alias("seq"), F.lit(7).alias("k"), F.lit(True).alias("f"))
    out = serial.prefix_count(df, ["k"], "seq", "f", "n", block=256)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")  # keep tiny test partitions apart
    try:
        parts = out.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set(key, old)
    assert parts > 1
    got = {r["seq"]: r["n"] for r in out.where("seq IN (0, 255, 256, 3999)").collect()}
    assert got == {0: 0, 255: 255, 256: 256, 3999: 3999}


def test_agendamento_strict_duplicates_then_seats(spark):
    import datetime as dt
    t = tables(spark)
    d5, d1 = dt.date(2031, 3, 5), dt.date(2031, 3, 11)
    req = spark.createDataFrame(
        [(1, "70000000001", 1, 1, 1, d5),   # seat 1 of 2
         (2, "70000000001", 1, 1, 1, d5),   # same cpf, lot, day -> duplicate
         (3, "70000000002", 1, 1, 1, d5),   # seat 2 of 2
         (4, "70000000003", 1, 1, 1, d5),   # site full that day
         (5, "70000000003", 1, 2, 1, d1),   # new (cpf, lot, day), but site 1 is already full on 03-01
         (6, "70000000001", 1, 1, 1, d1),   # same as appointment 1 in the table -> duplicate
         (7, "70000000005", 1, 1, 1, d5)],  # not a citizen, but the seat rule is checked before fk
        "req_seq long, cpf string, id_campanha int, id_vacina int, id_local int, data_agendamento date")
    new, dec = ch.apply_agendamento_insert(t, req, strict=True)
    got = {r["req_seq"]: (r["reason"], r["new_id"]) for r in dec.collect()}
    assert got == {1: (None, 5), 2: ("duplicate", None), 3: (None, 6), 4: ("full", None), 5: ("full", None),
                   6: ("duplicate", None), 7: ("full", None)}
    assert new["agendamento"].count() == 6


def test_running_counts_do_not_depend_on_the_spacing(spark):
    """Numbers 2**21 apart make a block of each request; every window partition stays within the block size."""
    n, step = 3000, 1 << 21
    df = spark.range(n).select((F.col("id") * step).alias("seq"), (F.col("id") % 2).alias("k"), (F.col("id") % 3 == 0).alias("f"))
    got = {r["seq"] // step: r["n"] for r in serial.prefix_count(df, ["k"], "seq", "f", "n").collect()}
    assert got == {i: sum(1 for j in range(i % 2, i, 2) if j % 3 == 0) for i in range(n)}
    block = 64  # the same with small blocks: blocks of a superblock, superblocks of a key
    got = {r["seq"] // step: r["n"] for r in serial.prefix_count(df, [], "seq", "f", "n", block).collect()}
    assert got == {i: (i + 2) // 3 for i in range(n)}
    blocks = df.select((F.col("seq") / block).cast("long").alias("b")).distinct().withColumn("s", (F.col("b") / block).cast("long"))
    assert blocks.groupBy("s").count().agg(F.max("count")).first()[0] <= block


def test_id_base_saves_the_scan(spark):
    import datetime as dt
    t = tables(spark)
    day = dt.date(2031, 3, 5)
    req = spark.createDataFrame([(1, "n", "d", "5", day, dt.date(2032, 1, 1), 3)], "req_seq long, nome string, doenca_alvo string, "
                                "codigo_lote string, data_chegada date, data_validade date, qtd_doses int")
    assert ch.apply_vacina_insert(t, req, id_base=500)[1].first()["new_id"] == 501
    req = spark.createDataFrame([(1, "70000000006", 1, 1, 1, day)],
                                "req_seq long, cpf string, id_campanha int, id_vacina int, id_local int, data_agendamento date")
    assert ch.apply_agendamento_insert(t, req, id_base=500)[1].first()["new_id"] == 501
    req = spark.createDataFrame([(1, "70000000006", "70000000002")], "req_seq long, cpf_responsavel string, cpf_parente string")
    assert ch.apply_parente_insert(t, req, id_base=500)[1].first()["new_id"] == 501


def test_scans_in_blocks_equal_loops(spark):
    """Stock walks, the value before and states, over sequence numbers with gaps, in blocks of 4."""
    rnd = random.Random(71)
    seqs = sorted(rnd.sample(range(3000), 240))
    rows = [(rnd.choice([1, 2, 2, 2, 3, None]), s, rnd.choice([-1, -1, 0, 1]), rnd.random() < .4, rnd.randrange(4)) for s in seqs]
    start = {1: 0, 2: 3, 3: 1, None: 2}
    # A transition of four states for each kind of row.
    steps = [[1, 2, 3, 0], [0, 0, 2, 2], [3, 3, 3, 3], [0, 1, 2, 3]]
    df = spark.createDataFrame([(k, s, d, f, start[k], steps[v], v) for k, s, d, f, v in rows],
                               "k int, seq long, d int, f boolean, start int, step array<int>, v int").repartition(5)
    stock, last, state = dict(start), {}, {k: n for k, n in start.items()}
    want_stock, want_last, want_state = {}, {}, {}
    for k, s, d, f, v in rows:
        want_stock[s], want_last[s], want_state[s] = stock[k], last.get(k), state[k]
        if d == 1 or (d == -1 and stock[k] > 0):
            stock[k] += d
        if f:
            last[k] = v
        state[k] = steps[v][state[k]]
    got = serial.stock_before(df, "k", "seq", "d", "start", "out", block=4)
    assert {r.seq: r.out for r in got.collect()} == want_stock
    got = serial.last_before(df, ["k"], "seq", "f", "v", "out", block=4)
    assert {r.seq: r.out for r in got.collect()} == want_last
    got = serial.scan_states(df.where("k is not null"), "k", "seq", "step", "start", 4, "out", block=4)
    assert {r.seq: r.out for r in got.collect()} == {s: want_state[s] for k, s, *_ in rows if k is not None}
