"""A feed of dose requests handled as micro-batches of the C19 operator.

Request files land in a folder; Structured Streaming picks them up and each
micro-batch runs ``apply_vacinacao_insert`` against the latest committed
state. State lives in a snapshot folder, ``root``, which may be any path that
Spark reads and writes:

* ``<root>/vacinacao/batch=<n>/``  rows appended by batch ``n`` (batch -1 is
  the initial load); the table is every committed batch folder;
* ``<root>/vacina/v=<n>/part=<p>/`` the parts of the lot table that batch ``n``
  changed (``sources.tables``: parts by a hash of the lot); the table is the
  newest committed version of each part;
* ``<root>/decisions/batch=<n>/``  decisions of batch ``n``, written first:
  rows and stock are derived from them;
* the manifest (``sources.tables``) has a row for each committed batch, with
  the streaming query's id and the last dose id handed out. It is written
  last; a batch without it never happened.

A batch in the manifest is skipped, so a replay after a lost executor or a
restarted query changes nothing twice. A batch number that another query
committed means that the streaming checkpoint was lost or exchanged: its
numbers start again, and skipping would drop new requests, so it raises.
A request (``req_seq``) that an earlier batch decided is not decided again: the
stream keeps the numbers it has seen in keyed state, which looks up only the
batch's own numbers, so the work of a micro-batch follows its size and not the
feed's age; the dose table is not read, and of the lots only the parts that the
requests name. ``process_batch`` without a stream looks the numbers up in the
committed decisions, and a number twice in its batch raises. Files read in ``req_seq`` order give
the same result as one batch over their union, because ids and stock carry
over from batch to batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.changes import apply_vacinacao_insert, require_unique_seq, stock_after
from ..sources import tables as tb
from ..sources.schemas import TABLES, request_schema

INITIAL = -1
STATIC = ("cidadao", "local", "campanha")
FEED = "dose_feed"


class CheckpointMismatch(RuntimeError):
    """The state was written by another streaming query than the one that asks."""


def _commits(spark: SparkSession, root: str) -> DataFrame:
    return tb.manifest(spark, root).where(F.col("name") == FEED)


def last_commit(spark: SparkSession, root: str) -> int | None:
    return _commits(spark, root).agg(F.max("version")).first()[0]


def init_state(root: str, tables: dict[str, DataFrame]) -> None:
    """Write the initial snapshot (batch -1) of the tables the feed reads."""
    spark = tables["vacinacao"].sparkSession
    if last_commit(spark, root) is not None:
        return
    tables["vacinacao"].write.mode("overwrite").parquet(f"{root}/vacinacao/batch={INITIAL}")
    parts = tb.write_parts(tables["vacina"], root, "vacina", INITIAL)
    for name in STATIC:
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}")
    top = tables["vacinacao"].agg(F.max("id_vacinacao")).first()[0]
    tb.commit(spark, root, [(FEED, INITIAL, None, int(top or 0)), *parts])


def read_state(spark: SparkSession, root: str, lot_parts: list[int] | None = None) -> dict[str, DataFrame]:
    """Committed state: appended dose batches up to the last commit, the lots
    (or those of the given parts), and the static tables."""
    last = last_commit(spark, root)
    if last is None:
        raise FileNotFoundError(f"no committed state under {root}")
    schema = T.StructType(list(TABLES["vacinacao"].schema.fields) + [T.StructField("batch", T.IntegerType())])
    doses = spark.read.schema(schema).option("basePath", f"{root}/vacinacao").parquet(f"{root}/vacinacao") \
        .where(F.col("batch") <= last).drop("batch")
    out = {"vacinacao": doses, "vacina": tb.read_parts(spark, root, "vacina", lot_parts)}
    for name in STATIC:
        out[name] = tb.read_table(spark, f"{root}/{name}", name)
    return out


def read_decisions(spark: SparkSession, root: str) -> DataFrame:
    """Decisions of all committed batches."""
    last = last_commit(spark, root)
    return spark.read.parquet(f"{root}/decisions").where(F.col("batch") <= last).drop("batch")


def committed(spark: SparkSession, root: str, batch_id: int, run: str) -> bool:
    """Whether the query ``run`` committed the batch; ``CheckpointMismatch`` when another did."""
    done = _commits(spark, root).where(F.col("version") == batch_id).first()
    if done is not None and done["run"] != run:
        raise CheckpointMismatch(f"batch {batch_id} under {root} was committed by query {done['run']}, not {run}: "
                                 "the streaming checkpoint was lost or exchanged")
    return done is not None


def last_id(spark: SparkSession, root: str) -> int:
    """The last dose id handed out."""
    return _commits(spark, root).orderBy(F.desc("version")).first()["last_id"]


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The query's id, which Spark keeps in its checkpoint: the same after a restart, another after a loss."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def _undecided(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """The requests that no committed batch has decided (a file may be sent again)."""
    try:
        decided = read_decisions(spark, root).select("req_seq")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return requests  # the first batch
    return requests.join(decided, "req_seq", "left_anti")


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
    state = read_state(spark, root, tb.parts_hit(requests, "id_vacina"))
    base = last_id(spark, root)
    _, dec = apply_vacinacao_insert(state, requests, id_base=base)
    path = f"{root}/decisions/batch={batch_id}"
    dec.write.mode("overwrite").parquet(path)
    dec = spark.read.schema(dec.schema).parquet(path)
    accepted = dec.where("accepted AND reason IS NULL").select("req_seq", F.col("new_id").alias("id_vacinacao"))
    added = requests.join(accepted, "req_seq").withColumn("cpf", C.strip_ws("cpf")).select(
        *[F.col(f.name).cast(f.dataType) for f in TABLES["vacinacao"].schema.fields])
    path = f"{root}/vacinacao/batch={batch_id}"
    added.write.mode("overwrite").parquet(path)
    taken = spark.read.schema(added.schema).parquet(path).select("id_vacina", F.lit(-1).alias("_d"))
    hit = tb.parts_hit(taken, "id_vacina")
    parts = tb.write_parts(stock_after(state["vacina"], taken), root, "vacina", batch_id, hit)
    top = dec.agg(F.max("new_id")).first()[0]
    tb.commit(spark, root, [(FEED, batch_id, run, int(top) if top is not None else base), *parts])
    return True


def start_dose_feed(spark: SparkSession, request_dir: str, root: str, checkpoint: str,
                    max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the streaming query; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(request_schema("vacinacao", with_key=False)).option("pathGlobFilter", "*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(request_dir).select(
        "req_seq", "contagem", "data_aplicacao", "id_vacina", "cpf", "id_local", "id_campanha").dropDuplicates(["req_seq"])

    def handle(batch_df: DataFrame, batch_id: int) -> None:
        session = batch_df.sparkSession
        process_batch(session, root, batch_df.persist(), int(batch_id), query_id(session, checkpoint), unseen=True)
        batch_df.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
