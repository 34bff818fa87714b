"""The dose-request feed through Structured Streaming."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from imunis.operators.changes import apply_vacinacao_insert
from imunis.sources import fixtures as fx
from imunis.streaming import feed

from paths import SF_SMALL


def _dec(df):
    return sorted((r["req_seq"], r["accepted"], r["reason"], r["new_id"]) for r in df.collect())


def test_feed_equals_one_batch_and_replays_idempotently(spark, scratch):
    t = fx.load(spark, SF_SMALL)
    state = {n: t[n] for n in ("vacinacao", "vacina", "cidadao", "local", "campanha")}
    req = t["vacinacao_request"]
    _, one = apply_vacinacao_insert(state, req)
    want = _dec(one)

    # k request files in req_seq order
    incoming = os.path.join(scratch, "incoming")
    bounds = req.agg(F.min("req_seq"), F.max("req_seq")).collect()[0]
    lo, hi = bounds[0], bounds[1] + 1
    k = 3
    step = (hi - lo) // k + 1
    for i in range(k):
        part = req.where((F.col("req_seq") >= lo + i * step) & (F.col("req_seq") < lo + (i + 1) * step))
        part.coalesce(1).write.parquet(os.path.join(incoming, f"f{i}"))
        os.replace(next(os.path.join(incoming, f"f{i}", n) for n in os.listdir(os.path.join(incoming, f"f{i}"))
                        if n.endswith(".parquet")), os.path.join(incoming, f"{i:03d}.parquet"))

    root = "file:" + os.path.join(scratch, "state")
    feed.init_state(root, state)
    q = feed.start_dose_feed(spark, incoming, root, os.path.join(scratch, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(300)
    assert feed.last_commit(spark, root) == k - 1
    assert _dec(feed.read_decisions(spark, root)) == want

    # replaying a committed batch changes nothing; another query's batch of that number is refused
    run = feed._commits(spark, root).where("version = 0").first()["run"]
    assert feed.process_batch(spark, root, req.limit(5), 0, run) is False
    with pytest.raises(feed.CheckpointMismatch):
        feed.process_batch(spark, root, req.limit(5), 0, "another query")
    # so a restart with a new checkpoint folder raises instead of dropping requests
    with pytest.raises(StreamingQueryException):
        feed.start_dose_feed(spark, incoming, root, os.path.join(scratch, "ckpt2"), max_files_per_trigger=1) \
            .awaitTermination(300)
    # requests sent again are not decided again; a number twice in a batch is refused
    assert feed.process_batch(spark, root, req.limit(5), k, run) is True
    with pytest.raises(ValueError):
        feed.process_batch(spark, root, req.limit(5).union(req.limit(5)), k + 1, run)
    assert _dec(feed.read_decisions(spark, root)) == want
    st = feed.read_state(spark, root)
    n_accepted = sum(1 for d in want if d[1] and d[2] is None)
    assert st["vacinacao"].count() == state["vacinacao"].count() + n_accepted


def test_batch_that_died_before_commit_is_invisible_and_replays(spark, scratch):
    t = fx.load(spark, SF_SMALL)
    state = {n: t[n] for n in ("vacinacao", "vacina", "cidadao", "local", "campanha")}
    req = t["vacinacao_request"]
    root = "file:" + os.path.join(scratch, "state")
    feed.init_state(root, state)
    # a first attempt of batch 0 wrote rows but never committed
    req.limit(7).withColumn("id_vacinacao", F.col("req_seq")).select(
        *[c for c in state["vacinacao"].columns]).write.parquet(f"{root}/vacinacao/batch=0")
    assert feed.read_state(spark, root)["vacinacao"].count() == state["vacinacao"].count()
    # the replay of batch 0 overwrites the partial folders and commits
    assert feed.process_batch(spark, root, req, 0) is True
    _, one = apply_vacinacao_insert(state, req)
    assert _dec(feed.read_decisions(spark, root)) == _dec(one)
    n_ok = one.where("accepted AND reason IS NULL").count()
    assert feed.read_state(spark, root)["vacinacao"].count() == state["vacinacao"].count() + n_ok


def test_requests_sent_again_are_dropped_by_the_stream_s_own_state(spark, scratch, monkeypatch):
    """Twelve files, each with the requests of the one before once more: no micro-batch reads the decisions."""
    t = fx.load(spark, SF_SMALL)
    state = {n: t[n] for n in ("vacinacao", "vacina", "cidadao", "local", "campanha")}
    req = t["vacinacao_request"].orderBy("req_seq").limit(120).cache()
    _, one = apply_vacinacao_insert(state, req)
    want = _dec(one)
    numbers = [d[0] for d in want]
    incoming = os.path.join(scratch, "incoming")
    os.makedirs(incoming)
    for i in range(12):
        part = req.where(F.col("req_seq").isin(numbers[max(0, i - 1) * 10:(i + 1) * 10]))
        part.union(part.limit(2)).coalesce(1).write.parquet(os.path.join(scratch, f"f{i}"))
        name = next(n for n in os.listdir(os.path.join(scratch, f"f{i}")) if n.endswith(".parquet"))
        os.replace(os.path.join(scratch, f"f{i}", name), os.path.join(incoming, f"{i:03d}.parquet"))
    root = "file:" + os.path.join(scratch, "state")
    feed.init_state(root, state)
    monkeypatch.setattr(feed, "_undecided", None)
    feed.start_dose_feed(spark, incoming, root, os.path.join(scratch, "ckpt"), max_files_per_trigger=1).awaitTermination(600)
    assert _dec(feed.read_decisions(spark, root)) == want
    st = feed.read_state(spark, root)
    ok = [d[0] for d in want if d[1] and d[2] is None]
    assert st["vacinacao"].count() == state["vacinacao"].count() + len(ok)
    # Each batch wrote at most a part of the lots for each of its ten requests; the stock is right.
    from imunis.sources import tables as tb
    parts = tb.manifest(spark, root).where("name like 'vacina/part=%' and version >= 0").groupBy("version").count().collect()
    assert parts and max(r["count"] for r in parts) <= 10
    taken = sum(r[0] for r in state["vacina"].select("qtd_doses").collect()) - sum(r[0] for r in st["vacina"].select("qtd_doses").collect())
    assert taken == len(ok) and st["vacina"].count() == state["vacina"].count()
