"""T1 for all dose requests: inserts, updates and deletes in one feed.

``feed`` takes inserts alone and appends. Updates and deletes reach back into
doses of any age, so here the dose table is kept in parts as well: ranges of
``DOSES_PER_PART`` ids, of which a micro-batch reads and rewrites only those that
hold a dose it names, and the last ones, into which new doses fall. A part has
at most that many rows however old the feed is.

* ``<root>/vacinacao/v=<n>/part=<p>/``, ``<root>/vacina/v=<n>/part=<p>/`` the parts
  of doses and lots that batch ``n`` changed;
* ``<root>/decisions/batch=<n>/`` the decisions of batch ``n``;
* the manifest, written last: a batch without it never happened, and its folders
  are written anew when it runs again.

Commits, replays and exchanged checkpoints are handled as in ``feed``; so are
requests that are sent again (the stream's keyed state drops them). Each
micro-batch has the outcome of its requests one by one in ``req_seq`` order
(``operators.dose_changes``), and ids, doses and stock carry over, so files read in
``req_seq`` order give the result of one serial run over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import require_unique_seq
from ..operators.dose_changes import INSERT, apply_vacinacao_changes
from ..sources import tables as tb
from ..sources.schemas import request_schema
from .feed import FEED, INITIAL, STATIC, _undecided, committed, last_commit, last_id, query_id

#: Ids in one part of the dose table.
DOSES_PER_PART = 1 << 20


def change_schema() -> T.StructType:
    """A request: req_seq, kind and the columns of a dose."""
    fields = request_schema("vacinacao").fields
    return T.StructType([fields[0], T.StructField("kind", T.StringType()), *fields[1:]])


def init_state(root: str, tables: dict[str, DataFrame], span: int = DOSES_PER_PART) -> None:
    """Write the initial snapshot (batch -1); ``span``: the ids of a dose part, the same for the state's whole life."""
    spark = tables["vacinacao"].sparkSession
    if last_commit(spark, root) is not None:
        return
    doses = tables["vacinacao"]
    parts = tb.write_parts(doses, root, "vacinacao", INITIAL, span=span) + tb.write_parts(tables["vacina"], root, "vacina", INITIAL)
    for name in STATIC:
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}")
    top = doses.agg(F.max("id_vacinacao")).first()[0]
    tb.commit(spark, root, [(FEED, INITIAL, None, int(top or 0)), ("vacinacao/span", INITIAL, None, span), *parts])


def _span(spark: SparkSession, root: str) -> int:
    row = tb.manifest(spark, root).where(F.col("name") == "vacinacao/span").first()
    if row is None:
        raise FileNotFoundError(f"no committed state under {root}")
    return row["last_id"]


def read_state(spark: SparkSession, root: str, dose_parts: list[int] | None = None, lot_parts: list[int] | None = None) -> dict[str, DataFrame]:
    """The committed tables, or the given parts of doses and lots."""
    out = {"vacinacao": tb.read_parts(spark, root, "vacinacao", dose_parts), "vacina": tb.read_parts(spark, root, "vacina", lot_parts)}
    for name in STATIC:
        out[name] = tb.read_table(spark, f"{root}/{name}", name)
    return out


def process_batch(spark: SparkSession, root: str, requests: DataFrame, batch_id: int, run: str = "direct",
                  unseen: bool = False) -> bool:
    """Apply one micro-batch of the query ``run``; False when it was committed
    before by that query, ``CheckpointMismatch`` when by another. ``unseen``:
    the caller knows that no earlier batch has these requests, and none twice."""
    if committed(spark, root, batch_id, run):
        return False
    if not unseen:
        require_unique_seq(requests)
        requests = _undecided(spark, root, requests)
    span, base = _span(spark, root), last_id(spark, root)
    named = requests.where(F.col("kind") != INSERT).select("id_vacinacao")
    doses = tb.read_parts(spark, root, "vacinacao", sorted({*tb.parts_hit(named, "id_vacinacao", span), base // span}))
    # Lots in question: those that a request names and those of the doses that it names.
    of_doses = doses.join(named.distinct(), "id_vacinacao", "left_semi").select("id_vacina")
    lot_parts = tb.parts_hit(requests.select("id_vacina").unionByName(of_doses), "id_vacina")
    state = {**read_state(spark, root, [], lot_parts), "vacinacao": doses}
    new, dec = apply_vacinacao_changes(state, requests, id_base=base)
    dec.write.mode("overwrite").parquet(f"{root}/decisions/batch={batch_id}")
    dec = spark.read.schema(dec.schema).parquet(f"{root}/decisions/batch={batch_id}")
    done = requests.join(dec.where("reason IS NULL"), "req_seq") \
        .select(F.coalesce("new_id", "id_vacinacao").alias("id_vacinacao"), F.when(F.col("kind") != "delete", F.col("id_vacina")).alias("id_vacina"))
    lots = done.select("id_vacina").unionByName(doses.join(done.select("id_vacinacao").distinct(), "id_vacinacao", "left_semi").select("id_vacina"))
    parts = tb.write_parts(new["vacinacao"], root, "vacinacao", batch_id, tb.parts_hit(done, "id_vacinacao", span), span) \
        + tb.write_parts(new["vacina"], root, "vacina", batch_id, tb.parts_hit(lots, "id_vacina"))
    top = dec.agg(F.max("new_id")).first()[0]
    tb.commit(spark, root, [(FEED, batch_id, run, base if top is None else int(top)), *parts])
    return True


def start_change_feed(spark: SparkSession, request_dir: str, root: str, checkpoint: str,
                      max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the streaming query over Parquet files of ``change_schema()``; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(change_schema()).option("pathGlobFilter", "*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(request_dir).dropDuplicates(["req_seq"])

    def handle(batch_df: DataFrame, batch_id: int) -> None:
        session = batch_df.sparkSession
        process_batch(session, root, batch_df.persist(), int(batch_id), query_id(session, checkpoint), unseen=True)
        batch_df.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
