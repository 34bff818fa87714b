"""Physical-plan properties the design relies on (checked with explain)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from imunis.operators import rules, serial
from imunis.plans import catalog
from imunis.sources import fixtures as fx

from paths import SF_SMALL

Q = E.queries()


def plan(spark, name):
    df = Q[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    p = plan(spark, "vacinacoes")
    assert "LessThanOrEqual(l_linenumber,4)" in p      # predicate pushed into the parquet scan
    assert "l_quantity" not in p and "l_tax" not in p  # unused lineitem columns are pruned


def test_disease_join_is_salted(spark):
    import re
    p = plan(spark, "agendamentos")
    assert "xxhash64" in p and "_salt" in p
    for part in re.findall(r"hashpartitioning\(([^)]*)\)", p):
        if "doenca_alvo" in part:
            assert "_salt" in part  # never shuffled on the disease alone


def test_page_is_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "page_vacinacoes")


def test_no_python_udf_anywhere(spark):
    """Read queries by their plan; change queries, which run while they are built, by their modules' source."""
    import inspect
    from imunis.operators import changes, filters, integrity, lists, serial
    reads = [n for n in catalog.QUERIES if not n.startswith(("usuario_", "vacina_", "campanha_", "local_", "parente_", "agendamento_",
                                                             "vacinacao_"))]
    assert len(reads) > 40
    for name in reads:
        p = plan(spark, name)
        assert not any(x in p for x in ("EvalPython", "InPandas", "MapInArrow")), name
    for module in (changes, filters, integrity, lists, rules, serial):
        assert "udf(" not in inspect.getsource(module) and "InPandas" not in inspect.getsource(module)


class _conf:
    """Spark settings for the length of a with block."""

    def __init__(self, spark, **settings):
        self.spark, self.settings = spark, {f"spark.sql.{k.replace('__', '.')}": v for k, v in settings.items()}

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


NO_BROADCAST = {"autoBroadcastJoinThreshold": "-1", "adaptive__autoBroadcastJoinThreshold": "-1"}


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_request_keys_are_split(spark):
    """A key that 80 % of the requests hold, looked up in a child table and in a parent table, alone and composite."""
    hot = F.when(F.col("id") % 5 < 4, 7).otherwise(F.col("id"))
    req = spark.range(0, 60_000, 1, 6).select("id", hot.alias("k"), (hot % 3).cast("int").alias("m"), F.repeat(F.lit("x"), 40).alias("pad"))
    child = spark.range(0, 90_000, 1, 6).select((F.col("id") % 30_000).alias("k"), (F.col("id") % 3).alias("m"))
    with _conf(spark, **NO_BROADCAST, adaptive__skewJoin__skewedPartitionThresholdInBytes="20k",
               adaptive__skewJoin__skewedPartitionFactor="2", adaptive__advisoryPartitionSizeInBytes="20k"):
        for on, unique in ((["k"], False), (["k", "m"], False), (["k"], True)):
            keys = child.dropDuplicates(["k"]).select("k") if unique else child
            if unique:
                keys = spark.range(0, 30_000, 1, 6).select(F.col("id").alias("k"))
            out = rules.key_flag(req, keys, on, "f", unique=unique)
            assert "SortMergeJoin(skew=true)" in final_plan(out), on
            assert out.count() == 60_000


def test_the_lines_move_once(spark):
    with _conf(spark, **NO_BROADCAST):
        plan = fx.load(spark, SF_SMALL)["dose_line"]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # lines and orders, each by order


def test_appointments_join_by_lot_once(spark):
    import re
    with _conf(spark, **NO_BROADCAST):
        plan = Q["agendamentos"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"SortMergeJoin \[id_vacina#\d+L?\], \[id_vacina#\d+L?\], LeftOuter", plan)) == 1


def test_strict_bookings_read_each_checkpoint_twice_at_most(spark):
    decisions = Q["agendamento_insert_strict"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert decisions.count("Scan ExistingRDD") == 1 and "Window" not in decisions
    req = spark.createDataFrame([(i, i % 3, True) for i in range(20)], "req_seq long, k long, f boolean").checkpoint()
    counted = serial.prefix_count(req, ["k"], "req_seq", "f", "n")._jdf.queryExecution().executedPlan().toString()
    assert counted.count("Scan ExistingRDD") <= 3  # rows, their blocks, the superblocks of those
