"""Bind the driver's TPC-H-style tables to the ten programme tables.

The rules are those of FIXTURES.md §2. Everything is a lazy DataFrame over
the parquet scans, so a query only reads the tables and columns it uses and
its filters reach the scan.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import TABLES

# Fixed values of the bindings.
AS_OF = dt.date(1998, 6, 1)
CAMPAIGN_DISEASES = ["ECONOMY", "SMALL", "MEDIUM", "STANDARD", "LARGE"]
BASE_DATE = "1995-01-01"
CAMPAIGN_START = "1995-06-01"
# Doses use the first 22 of the 25 campaigns; the others are unreferenced.
DOSE_CAMPAIGNS = 22
# Ids from here on are spare lots and sites, which no dose refers to.
SPARE = 10**15
# Ids from here on belong to no row.
UNKNOWN = 2 * 10**15

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Declared schemas of the driver tables: reading with a schema skips the
# footer inference of every scan.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
}


def cpf(col) -> F.Column:
    """Driver key -> 11-digit CPF text."""
    return F.lpad(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), 11, "0")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(DRIVER_SCHEMAS[name]) if name in DRIVER_SCHEMAS else spark.read
    return reader.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _booked_lot():
    """The line's lot; for every 23rd order a spare lot of the same twenty."""
    spare = F.floor(F.col("l_partkey") / 20) * 20 + 7 + SPARE
    return F.when(F.col("l_orderkey") % 23 == 0, spare).otherwise(F.col("l_partkey") + 1).cast("bigint")


class Fixtures:
    """Lazy accessor for the bound tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = _read(self.spark, self.sf_dir, name)
        return self._raw[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name.endswith("_req"):
                from . import requests
                self._cache[name] = getattr(requests, name)(self)
            else:
                self._cache[name] = getattr(self, f"_build_{name}")()
        return self._cache[name]

    def tables(self, *names: str) -> dict[str, DataFrame]:
        names = names or tuple(TABLES)
        return {n: self[n] for n in names}

    def _build_vacina_scarce(self) -> DataFrame:
        """The lots with hardly any stock."""
        return self["vacina"].withColumn("qtd_doses", (F.col("id_vacina") % 5).cast("int"))

    # -- dimensions -------------------------------------------------------
    def _build_usuario(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            cpf("c_custkey").alias("cpf"),
            F.col("c_name").alias("nome"),
            F.concat(F.lit("("), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(") 9"),
                     F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("telefone"),
        )

    def _build_cidadao(self) -> DataFrame:
        c = self.raw("customer").where(F.col("c_custkey") % 10 <= 6)
        n = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.raw("region").select("r_regionkey", "r_name")
        k = F.col("c_custkey")
        return (
            c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .select(
                cpf("c_custkey").alias("cpf"),
                F.when(k % 7 == 0, F.lit(None).cast("string"))
                .otherwise(F.lpad(k.cast("string"), 15, "7")).alias("cartao_sus"),
                F.concat(F.lit("Rua "), (k % 50).cast("string")).alias("rua"),
                F.col("c_mktsegment").alias("bairro"),
                (k % 1000).cast("int").alias("numero"),
                F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("cidade"),
                F.substring("r_name", 1, 2).alias("estado"),
            )
        )

    def _build_administrador(self) -> DataFrame:
        c = self.raw("customer").where((F.col("c_custkey") % 10).isin(6, 7))
        return c.select(
            cpf("c_custkey").alias("cpf"),
            F.concat(F.lit("Posto "), (F.col("c_custkey") % 100).cast("string")).alias("local_trabalho"),
        )

    def _build_agente_saude(self) -> DataFrame:
        c = self.raw("customer").where((F.col("c_custkey") % 10).isin(7, 8))
        return c.select(
            cpf("c_custkey").alias("cpf"),
            F.concat(F.lit("agente"), F.col("c_custkey").cast("string"), F.lit("@x.br")).alias("email"),
            F.concat(F.lit("Posto "), (F.col("c_custkey") % 100).cast("string")).alias("posto_trabalho"),
        )

    def _build_vacina(self) -> DataFrame:
        """A lot for each part, and a spare lot for every twentieth."""
        p, k = self.raw("part"), F.col("p_partkey")
        return self._lots(p, k + 1).unionByName(self._lots(p.where(k % 20 == 7), k + SPARE))

    @staticmethod
    def _lots(p: DataFrame, key) -> DataFrame:
        day = (F.col("p_partkey") % 1500).cast("int")
        return p.select(
            key.cast("bigint").alias("id_vacina"),
            F.col("p_name").alias("nome"),
            F.col("p_type").alias("doenca_alvo"),
            F.regexp_replace("p_brand", "[^0-9]", "").alias("codigo_lote"),
            F.date_add(F.lit(BASE_DATE).cast("date"), day).alias("data_chegada"),
            F.date_add(F.lit(BASE_DATE).cast("date"), day + (F.col("p_size") * 30).cast("int")).alias("data_validade"),
            (F.col("p_size") - 1).cast("int").alias("qtd_doses"),
        )

    def _build_local(self) -> DataFrame:
        """A site for each supplier, and a spare site for every tenth."""
        s, k = self.raw("supplier"), F.col("s_suppkey")
        return self._sites(s, k + 1).unionByName(self._sites(s.where(k % 10 == 3), k + SPARE))

    def _sites(self, s: DataFrame, key) -> DataFrame:
        n = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        k = F.col("s_suppkey")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            key.cast("bigint").alias("id_local"),
            F.col("s_name").alias("nome"),
            F.concat(F.lit("Rua "), (k % 50).cast("string")).alias("rua"),
            F.concat(F.lit("Bairro "), (k % 20).cast("string")).alias("bairro"),
            (k + 1).cast("int").alias("numero"),
            F.col("n_name").alias("cidade"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("estado"),
            F.concat(F.lit("(11) 9"), F.lpad(k.cast("string"), 8, "0")).alias("contato"),
            F.when(k % 9 == 0, F.lit(None).cast("int")).otherwise((k % 4 + 1).cast("int")).alias("capacidade"),
        )

    def _build_campanha(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        start = F.date_add(F.lit(CAMPAIGN_START).cast("date"), (k * 60).cast("int"))
        disease = F.element_at(F.array(*[F.lit(d) for d in CAMPAIGN_DISEASES]), (k % 5 + 1).cast("int"))
        return n.select(
            (k + 1).cast("int").alias("id_campanha"),
            F.concat(F.lit("Campanha "), F.col("n_name")).alias("nome"),
            disease.alias("doenca_alvo"),
            F.when(k % 2 == 0, F.lit("Dose Única")).otherwise(F.lit("Múltiplas Doses")).alias("tipo_vacina"),
            start.alias("data_inicio"),
            F.when(k % 5 == 0, F.lit(None).cast("date")).otherwise(F.date_add(start, 400)).alias("data_fim"),
            F.when(k % 4 == 0, F.lit("População geral"))
            .otherwise(F.concat(F.lit("Moradores de "), F.col("n_name"))).alias("publico_alvo"),
        )

    # -- facts ------------------------------------------------------------
    def _build_dose_line(self) -> DataFrame:
        """lineitem with one row per (l_orderkey, l_linenumber), joined to orders.

        The join comes first: it shuffles the lines by order, and the
        keep-first window (``row_number() = 1`` by order and line) uses that
        partitioning as it is, so the lines move once. The join itself needs
        all lines of an order together; an order has few.
        """
        li = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                         "l_shipdate", "l_extendedprice")
        w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
            "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey") \
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "l_extendedprice")

    def _build_vacinacao(self) -> DataFrame:
        d = self["dose_line"].where((F.col("l_linenumber") <= 4) & (F.col("o_custkey") % 10 <= 6))
        return d.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("id_vacinacao"),
            F.col("l_linenumber").cast("int").alias("contagem"),
            F.col("l_shipdate").cast("date").alias("data_aplicacao"),
            (F.col("l_partkey") + 1).cast("bigint").alias("id_vacina"),
            cpf("o_custkey").alias("cpf"),
            (F.col("l_suppkey") + 1).cast("bigint").alias("id_local"),
            (F.col("l_orderkey") % DOSE_CAMPAIGNS + 1).cast("int").alias("id_campanha"),
        )

    def _build_vacinacao_all(self) -> DataFrame:
        """Doses without the citizen filter: about 30 % orphan cpfs (audits)."""
        d = self["dose_line"].where(F.col("l_linenumber") <= 4)
        return d.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("id_vacinacao"),
            F.col("l_linenumber").cast("int").alias("contagem"),
            F.col("l_shipdate").cast("date").alias("data_aplicacao"),
            (F.col("l_partkey") + 1).cast("bigint").alias("id_vacina"),
            cpf("o_custkey").alias("cpf"),
            (F.col("l_suppkey") + 1).cast("bigint").alias("id_local"),
            (F.col("l_orderkey") % DOSE_CAMPAIGNS + 1).cast("int").alias("id_campanha"),
        )

    def _build_vacinacao_raw(self) -> DataFrame:
        """Doses loaded without the keep-first rule: repeated ids (K1 audit)."""
        li = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        d = li.join(o, li.l_orderkey == o.o_orderkey).where(
            (F.col("l_linenumber") <= 4) & (F.col("o_custkey") % 10 <= 6))
        return d.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("id_vacinacao"),
            F.col("l_linenumber").cast("int").alias("contagem"),
            F.col("l_shipdate").cast("date").alias("data_aplicacao"),
            (F.col("l_partkey") + 1).cast("bigint").alias("id_vacina"),
            cpf("o_custkey").alias("cpf"),
            (F.col("l_suppkey") + 1).cast("bigint").alias("id_local"),
            (F.col("l_orderkey") % DOSE_CAMPAIGNS + 1).cast("int").alias("id_campanha"),
        )

    def _build_vacinacao_request(self) -> DataFrame:
        d = self["dose_line"].where(F.col("l_linenumber") >= 5)
        k = F.col("l_orderkey")
        return d.select(
            (k * 8 + F.col("l_linenumber")).cast("bigint").alias("req_seq"),
            F.when(k % 53 == 0, 0).otherwise(F.col("l_linenumber")).cast("int").alias("contagem"),
            F.when(k % 61 != 0, F.col("l_shipdate").cast("date")).alias("data_aplicacao"),
            (F.col("l_partkey") + F.when(k % 43 == 0, UNKNOWN).otherwise(1)).cast("bigint").alias("id_vacina"),
            F.when(k % 67 == 0, "").otherwise(cpf("o_custkey")).alias("cpf"),
            (F.col("l_suppkey") + 1).cast("bigint").alias("id_local"),
            (F.col("l_orderkey") % 27 + 1).cast("int").alias("id_campanha"),
        )

    def _build_agendamento(self) -> DataFrame:
        d = self["dose_line"].where((F.col("l_linenumber") == 1) & (F.col("o_custkey") % 10 <= 6))
        return d.select(
            F.col("l_orderkey").cast("bigint").alias("id_agendamento"),
            F.col("o_orderdate").cast("date").alias("data_agendamento"),
            _booked_lot().alias("id_vacina"),
            (F.col("l_suppkey") + 1).cast("bigint").alias("id_local"),
            cpf("o_custkey").alias("cpf"),
        )

    def _build_agendamento_all(self) -> DataFrame:
        d = self["dose_line"].where(F.col("l_linenumber") == 1)
        return d.select(
            F.col("l_orderkey").cast("bigint").alias("id_agendamento"),
            F.col("o_orderdate").cast("date").alias("data_agendamento"),
            _booked_lot().alias("id_vacina"),
            (F.col("l_suppkey") + 1).cast("bigint").alias("id_local"),
            cpf("o_custkey").alias("cpf"),
        )

    def _build_parente(self) -> DataFrame:
        c = self.raw("customer").where(F.col("c_custkey") % 10 <= 5)
        return c.select(
            F.col("c_custkey").cast("bigint").alias("id_parentesco"),
            cpf("c_custkey").alias("cpf_responsavel"),
            cpf(F.col("c_custkey") + 1).alias("cpf_parente"),
        )

    def _build_parente_all(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").cast("bigint").alias("id_parentesco"),
            cpf("c_custkey").alias("cpf_responsavel"),
            cpf(F.col("c_custkey") + 1).alias("cpf_parente"),
        )


    # -- tables with faults, for the audits (every rule of K2, K4 and K6 finds some) --
    def _build_usuario_bad(self) -> DataFrame:
        u, last = self["usuario"], F.substring("cpf", 11, 1)
        return u.withColumn("telefone", F.when(last != "7", F.col("telefone"))) \
            .withColumn("nome", F.when(last == "3", F.repeat("nome", 8)).otherwise(F.col("nome")))

    def _build_cidadao_bad(self) -> DataFrame:
        c = self["cidadao"]
        return c.withColumn("cpf", F.when(F.col("numero") % 41 == 0, F.concat(F.lit("X"), "cpf")).otherwise(F.col("cpf")))

    def _build_vacina_bad(self) -> DataFrame:
        v, k = self["vacina"], F.col("id_vacina")
        return v.withColumn("qtd_doses", F.when(k % 13 == 0, -1).otherwise(F.col("qtd_doses"))) \
            .withColumn("codigo_lote", F.when(k % 17 == 0, F.concat(F.lit("L-"), "codigo_lote")).otherwise(F.col("codigo_lote"))) \
            .withColumn("doenca_alvo", F.when(k % 19 != 0, F.col("doenca_alvo")))

    def _build_local_bad(self) -> DataFrame:
        lo, k = self["local"], F.col("id_local")
        return lo.withColumn("numero", F.when(k % 5 == 0, 0).otherwise(F.col("numero"))) \
            .withColumn("capacidade", F.when(k % 7 == 0, -1).otherwise(F.col("capacidade"))) \
            .withColumn("estado", F.when(k % 3 == 0, F.lit("RJX")).otherwise(F.col("estado"))) \
            .withColumn("contato", F.when(k % 4 != 0, F.col("contato")))

    def _build_campanha_bad(self) -> DataFrame:
        c = self["campanha"]
        return c.withColumn("tipo_vacina", F.when(F.col("id_campanha") % 6 == 0, F.lit("Toxoide")).otherwise(F.col("tipo_vacina")))

    def _build_vacinacao_bad(self) -> DataFrame:
        d, k = self["vacinacao_all"], F.col("id_vacinacao")
        return d.withColumn("contagem", F.when(k % 97 == 0, 0).otherwise(F.col("contagem"))) \
            .withColumn("id_vacina", F.when(k % 101 == 0, F.col("id_vacina") + UNKNOWN).otherwise(F.col("id_vacina"))) \
            .withColumn("id_local", F.when(k % 103 == 0, F.col("id_local") + UNKNOWN).otherwise(F.col("id_local"))) \
            .withColumn("id_campanha", F.when(k % 107 == 0, F.col("id_campanha") + 100).otherwise(F.col("id_campanha")))

    def _build_agendamento_bad(self) -> DataFrame:
        a, k = self["agendamento_all"], F.col("id_agendamento")
        return a.withColumn("id_vacina", F.when(k % 101 == 0, F.col("id_vacina") + UNKNOWN).otherwise(F.col("id_vacina"))) \
            .withColumn("id_local", F.when(k % 103 == 0, F.col("id_local") + UNKNOWN).otherwise(F.col("id_local")))


def load(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)
