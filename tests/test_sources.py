"""Sources, lookups and snapshots."""

import pytest
from pyspark.sql import functions as F

from imunis.sources import tables as tb
from imunis.sources.schemas import TABLES

from seed import tables


def test_param_lookup_binds_values(spark):
    t = tables(spark)
    df = spark.sql("SELECT id_vacina FROM {v} WHERE doenca_alvo = :d AND qtd_doses > :n",
                   args={"d": "Influenza B", "n": 1}, v=t["vacina"])
    assert [r[0] for r in df.collect()] == [1]
    tb.register_views(spark, {"vacina_seed": t["vacina"]})
    out = tb.param_lookup(spark, "SELECT count(*) FROM vacina_seed WHERE nome ILIKE :p", {"p": "%' OR 1=1 --%"})
    assert out.collect()[0][0] == 0
    out = tb.param_lookup(spark, "SELECT id_vacina FROM {lots} WHERE qtd_doses > :n", {"n": 4}, lots=t["vacina"])
    assert sorted(r[0] for r in out.collect()) == [1, 3]


def test_table_exists_and_lower(spark):
    t = tables(spark)
    t["campanha"].createOrReplaceTempView("campanha_seed")
    assert tb.table_exists(spark, "CAMPANHA_SEED")
    assert not tb.table_exists(spark, "nope'; drop")
    df = t["campanha"].toDF(*[c.upper() for c in t["campanha"].columns])
    assert tb.lower_columns(df).columns == t["campanha"].columns


def test_snapshot_versions(spark, scratch):
    scratch = "file:" + scratch
    t = tables(spark)
    assert tb.latest_snapshot(spark, scratch, "vacina") is None
    tb.write_snapshot(t["vacina"], scratch, "vacina", 0)
    tb.write_snapshot(t["vacina"].where("id_vacina > 2"), scratch, "vacina", 1)
    t["vacina"].write.parquet(f"{scratch}/vacina/v=2")  # written, but never committed
    assert tb.snapshot_versions(spark, scratch, "vacina") == [0, 1]
    assert tb.latest_snapshot(spark, scratch, "vacina").count() == 2


def test_commit_batch_versions(spark, scratch):
    scratch = "file:" + scratch
    from imunis.operators import changes as ch
    t = tables(spark)
    for name in ("vacina", "vacinacao"):
        tb.write_snapshot(t[name], scratch, name, 0)
    req = spark.createDataFrame([(1, 1)], "req_seq long, id_vacinacao long")
    state = {**t, "vacina": tb.latest_snapshot(spark, scratch, "vacina"),
             "vacinacao": tb.latest_snapshot(spark, scratch, "vacinacao")}
    new, dec = ch.apply_vacinacao_delete(state, req)
    t["vacinacao"].limit(1).write.parquet(f"{scratch}/vacinacao/v=2")  # a batch that died before its commit
    tb.commit_batch(scratch, 1, new, dec)
    assert tb.snapshot_versions(spark, scratch, "vacinacao") == [0, 1]
    assert tb.latest_snapshot(spark, scratch, "vacinacao").count() == 2
    stock = {r["id_vacina"]: r["qtd_doses"] for r in tb.latest_snapshot(spark, scratch, "vacina").collect()}
    assert stock[1] == 6


def test_a_committed_version_is_not_overwritten(spark, scratch):
    root = "file:" + scratch
    t = tables(spark)
    dec = spark.createDataFrame([(1, True)], "req_seq long, accepted boolean")
    tb.commit_batch(root, 1, {"vacina": t["vacina"]}, dec)
    for again in (lambda: tb.commit_batch(root, 1, {"vacina": t["vacina"].limit(1)}, dec),
                  lambda: tb.write_snapshot(t["vacina"].limit(1), root, "vacina", 1, mode="overwrite")):
        with pytest.raises(ValueError, match="committed"):
            again()
    assert tb.latest_snapshot(spark, root, "vacina").count() == t["vacina"].count()
    assert tb.manifest(spark, root).count() == 2


def test_parts(spark, scratch):
    """A batch writes the parts of the keys it changes, and what it did not commit is not seen."""
    root = "file:" + scratch
    lots = spark.range(1, 2001).select(F.col("id").alias("id_vacina"), *[F.lit(None).cast(f.dataType).alias(f.name)
                                       for f in TABLES["vacina"].schema.fields[1:-1]], F.lit(5).alias("qtd_doses"))
    assert tb.read_parts(spark, root, "vacina").count() == 0
    tb.commit(spark, root, tb.write_parts(lots, root, "vacina", 0))
    assert tb.read_parts(spark, root, "vacina").count() == 2000
    some = spark.range(1, 11).withColumnRenamed("id", "id_vacina")
    hit = tb.parts_hit(some, "id_vacina")
    now = tb.read_parts(spark, root, "vacina", hit).withColumn("qtd_doses", F.when(F.col("id_vacina") <= 10, 4).otherwise(F.col("qtd_doses")))
    rows = tb.write_parts(now, root, "vacina", 1, hit)
    assert len(rows) == len(hit) <= 10
    assert tb.read_parts(spark, root, "vacina").where("qtd_doses = 4").count() == 0
    tb.commit(spark, root, rows)
    after = tb.read_parts(spark, root, "vacina")
    assert after.count() == 2000 and sorted(r[0] for r in after.where("qtd_doses = 4").select("id_vacina").collect()) == list(range(1, 11))
