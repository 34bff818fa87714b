"""The feed of dose inserts, updates and deletes through Structured Streaming."""

import os
import random

import pytest
from pyspark.sql import functions as F

from imunis.sources import tables as tb
from imunis.streaming import change_feed, feed

from seed import tables
from test_dose_changes import VALUES, frame, serial_outcome
from test_loops import batch, stored


def drop(spark, reqs, scratch, incoming, i):
    path = os.path.join(scratch, f"f{i}")
    frame(spark, reqs).coalesce(1).write.parquet(path)
    name = next(n for n in os.listdir(path) if n.endswith(".parquet"))
    os.replace(os.path.join(path, name), os.path.join(incoming, f"{i:03d}.parquet"))


def test_mixed_feed_equals_serial_replay(spark, scratch):
    """Three files, the last with requests of the one before once more; then a lost checkpoint and a torn batch."""
    reqs = sorted(batch(random.Random(4), VALUES, 45), key=lambda r: r["req_seq"])
    incoming = os.path.join(scratch, "incoming")
    os.makedirs(incoming)
    for i, part in enumerate((reqs[:15], reqs[15:30], reqs[25:])):
        drop(spark, part, scratch, incoming, i)
    root, ckpt = "file:" + os.path.join(scratch, "state"), os.path.join(scratch, "ckpt")
    change_feed.init_state(root, tables(spark), span=4)
    change_feed.start_change_feed(spark, incoming, root, ckpt, max_files_per_trigger=1).awaitTermination(600)
    want = serial_outcome(reqs)
    dec = feed.read_decisions(spark, root).collect()
    assert len(dec) == len(reqs) and {r["req_seq"]: (r["reason"], r["new_id"]) for r in dec} == want[0]
    state = change_feed.read_state(spark, root)
    assert stored(state["vacinacao"], "vacinacao") == want[1]
    assert {r["id_vacina"]: r["qtd_doses"] for r in state["vacina"].collect()} == want[2]

    # A batch commits the parts of the doses it changed and no others.
    put = {r["req_seq"]: want[0][r["req_seq"]] for r in reqs[:15]}
    hit = {(put[r["req_seq"]][1] or r["id_vacinacao"]) // 4 for r in reqs[:15] if put[r["req_seq"]][0] is None}
    wrote = tb.manifest(spark, root).where("version = 0 AND name LIKE 'vacinacao/part=%'").collect()
    assert {int(r["name"].split("=")[1]) for r in wrote} == hit

    # Replays change nothing; another query's number is refused; folders of a torn batch are written anew.
    run = feed._commits(spark, root).where("version = 0").first()["run"]
    assert change_feed.process_batch(spark, root, frame(spark, reqs[:5]), 0, run) is False
    with pytest.raises(feed.CheckpointMismatch):
        change_feed.process_batch(spark, root, frame(spark, reqs[:5]), 0, "another query")
    more = [{**r, "req_seq": 1000 + r["req_seq"]} for r in reqs[:12]]
    state["vacinacao"].limit(1).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{root}/vacinacao/v=3")
    assert stored(change_feed.read_state(spark, root)["vacinacao"], "vacinacao") == want[1]
    assert change_feed.process_batch(spark, root, frame(spark, reqs[40:] + more), 3, run) is True
    # Ids go on behind the last one handed out, also where that dose was deleted since.
    want = serial_outcome(reqs + more)
    assert {r["req_seq"]: (r["reason"], r["new_id"]) for r in feed.read_decisions(spark, root).collect()} == want[0]
    assert stored(change_feed.read_state(spark, root)["vacinacao"], "vacinacao") == want[1]


def test_no_state_is_an_error(spark, scratch):
    with pytest.raises(FileNotFoundError):
        change_feed.process_batch(spark, "file:" + os.path.join(scratch, "none"), frame(spark, [
            {"req_seq": 1, "kind": "delete", **dict.fromkeys(["id_vacinacao", "contagem", "data_aplicacao", "id_vacina", "cpf", "id_local", "id_campanha"])}]), 0)
