"""The domain tables (genotype, phenotype, samples of a chain) derived from the order tables.

An individual is a customer, a marker is a part (or a supplier), a cell's dosage is the number of purchases up to 2, missing
if every purchase of the cell was returned in bulk. Customers below zero have no phenotype and are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def individuals(self) -> DataFrame:
        """ind_id, y: those with a phenotype."""
        return self.table("customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("ind_id"), F.col("c_acctbal").alias("y"))

    def genotype(self, marker: str = "l_partkey") -> DataFrame:
        """ind_id, marker_id, d: the cells that are not zero, of individuals with a phenotype; d is null where missing."""
        return self.cells(marker).join(self.individuals().select("ind_id"), "ind_id", "left_semi").select("ind_id", "marker_id", "d")

    def traits(self) -> DataFrame:
        """ind_id, trait, y: two traits of every individual, null where a trait isn't known."""
        o = self.table("orders").groupBy(F.col("o_custkey").alias("ind_id")).agg(F.count("*").alias("o"))
        c = self.table("customer").select(F.col("c_custkey").alias("ind_id"), F.col("c_acctbal").alias("b")).join(o, "ind_id", "left").withColumn("o", F.coalesce("o", F.lit(0)))
        y = F.array(F.when(F.col("b") >= 0, F.col("b")), F.when(F.col("o") % 3 != 0, F.col("o").cast("double")))
        return c.select("ind_id", F.posexplode(y).alias("trait", "y"))

    def cells(self, marker: str = "l_partkey") -> DataFrame:
        """ind_id, marker_id, d of all individuals."""
        mis = F.min(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), 1).otherwise(0))
        lines = self.table("lineitem").select("l_orderkey", F.col(marker).alias("marker_id"), "l_returnflag", "l_quantity")
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("ind_id"))
        cells = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("ind_id", "marker_id").agg(F.count("*").alias("c"), mis.alias("mis"))
        d = F.when(F.col("mis") == 1, None).when(F.col("c") >= 2, 2).otherwise(1)
        return cells.select("ind_id", "marker_id", d.cast("int").alias("d"))

    def phenotype(self) -> DataFrame:
        """ind_id, y with mean 0 and variance 1; the two moments are an aggregate of one row."""
        return standardized(self.individuals(), "y")

    def failure(self) -> DataFrame:
        """ind_id, fail: 1 if any order of the individual failed."""
        o = self.table("orders").groupBy(F.col("o_custkey").alias("ind_id")).agg(F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("fail"))
        return self.individuals().select("ind_id").join(o, "ind_id", "left").select("ind_id", F.coalesce("fail", F.lit(0)).alias("fail"))

    def samples(self) -> DataFrame:
        """iter, marker_id, component, beta: one sample per iteration and marker, that of the largest event_id."""
        e = self.table("events").withColumns({"iter": F.expr("event_id div 100"), "marker_id": F.col("user_id")})
        e = e.groupBy("iter", "marker_id").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("s"))
        k = F.when(F.col("s.event_type") == "view", 0).when(F.col("s.event_type") == "click", 1).when(F.col("s.event_type") == "purchase", 2).otherwise(3)
        return e.select("iter", "marker_id", k.alias("component"), F.when(k == 0, 0.0).otherwise((F.col("s.value") - 100) / 1000).alias("beta"))


def standardized(df: DataFrame, col: str) -> DataFrame:
    m = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    return df.withColumn(col, (F.col(col) - F.lit(m.m)) / F.lit(m.s))
