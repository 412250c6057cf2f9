"""The driver's tables seen as samples, systems, ZIPs, timing tables and runs (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkplume.operators.spatial import CELL_SIZE, Grid, train_test_split
from sparkplume.plans.prepare import dataset_points
from sparkplume.session import materialize

GRID = Grid(0.0, 0.0, 25000.0, 40, 40)
FINE = Grid(0.0, 0.0, CELL_SIZE, 125, 125)  # the same extent in cells of five miles
AREA = [(100000.0, 50000.0), (900000.0, 150000.0), (800000.0, 950000.0), (450000.0, 600000.0), (150000.0, 900000.0)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def systems(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return (
        table(spark, sf, "customer")
        .where(k % 20 != 0)
        .select(
            k.alias("system_id"),
            ((k * 7919 % 100003).cast("double") * 10.0).alias("x"),
            ((k * 104729 % 99991).cast("double") * 10.0).alias("y"),
        )
    )


WATER_OF_STATUS = {"F": "GW", "O": "SW"}
CONTAMINANT_OF_PRIORITY = {"1-URGENT": "PFOA", "2-HIGH": "PFOS"}


def samples(
    spark: SparkSession, sf: str, contaminants: Sequence[str] | None = None, water_types: Sequence[str] | None = None
) -> DataFrame:
    """All samples, or those of some datasets; the latter condition is put in the table's own terms,
    so that the scan can skip row groups."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    date = F.col("o_orderdate").cast("date")
    orders = table(spark, sf, "orders")
    if water_types is not None:
        orders = orders.where(status.isin(*[k for k, v in WATER_OF_STATUS.items() if v in water_types]))
    if contaminants is not None:
        orders = orders.where(priority.isin(*[k for k, v in CONTAMINANT_OF_PRIORITY.items() if v in contaminants]))
    people = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return (
        orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("o_custkey").alias("system_id"),
            F.col("c_name").alias("system_name"),
            F.col("c_mktsegment").alias("size"),
            F.when(status == "F", "GW").when(status == "O", "SW").otherwise("MX").alias("water_type"),
            F.when(priority == "1-URGENT", "PFOA").when(priority == "2-HIGH", "PFOS").otherwise("OTHER").alias("contaminant"),
            F.lit(0.004).alias("mrl"),
            F.lit("ug/L").alias("units"),
            F.col("n_regionkey").cast("long").alias("region"),
            F.col("n_name").alias("state"),
            F.when(F.col("o_orderkey") % 5 >= 2, F.col("o_totalprice") / 5000000.0).alias("value"),
            date.alias("collection_date"),
            F.concat(
                F.month(date).cast("string"), F.lit("/"), F.dayofmonth(date).cast("string"), F.lit("/"), F.year(date).cast("string")
            ).alias("collection_text"),
        )
    )


def zips(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return (
        table(spark, sf, "orders")
        .where(F.col("o_custkey") % 25 != 0)
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(F.col("o_custkey").alias("system_id"), (F.col("l_suppkey") * 37 % 1200).cast("string").alias("zip"))
        .distinct()
    )


def bridge_rows(spark: SparkSession, sf: str) -> DataFrame:
    """System-ZIP rows with their repeats, for counting."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return (
        table(spark, sf, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(F.col("o_custkey").alias("system_id"), (F.col("l_suppkey") * 37 % 1200).cast("string").alias("zip"))
    )


def points(spark: SparkSession, sf: str, contaminant: str = "PFOA", water_type: str = "GW") -> DataFrame:
    rows = samples(spark, sf, [contaminant], [water_type])
    return dataset_points(rows, systems(spark, sf), contaminant, water_type)


def train_test(spark: SparkSession, sf: str, contaminant: str = "PFOA", water_type: str = "GW") -> tuple[DataFrame, DataFrame]:
    split = materialize(train_test_split(points(spark, sf, contaminant, water_type), 90, 42), "split")
    return split.where("is_train").drop("is_train"), split.where("NOT is_train").drop("is_train")


def area(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(AREA)], "i long, x double, y double")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of interpolation runs with parameters and scores, one per order line."""
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda values, index, dtype: F.element_at(
        F.array(*[F.lit(v).cast(dtype) for v in values]), (index % len(values) + 1).cast("int")
    )
    fixed = supp % 2 == 0
    method = pick(["IDW", "OK", "UK"], part, "string")
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")])
        .select(
            (F.col("l_orderkey") * 100 + line).alias("log_id"),
            method.alias("method"),
            F.concat(pick(["PFOA", "PFOS"], F.col("l_orderkey"), "string"), F.lit("_"), pick(["GW", "SW"], supp, "string")).alias("dataset"),
            F.when(method == "OK", pick(["Spherical", "Circular", "Exponential", "Gaussian", "Linear"], supp, "string"))
            .when(method == "UK", pick(["LinearDrift", "QuadDrift"], part, "string"))
            .alias("model"),
            F.when(fixed, "fixed").otherwise("variable").alias("type"),
            F.when(method == "IDW", pick([0.5, 1.0, 2.0, 3.0], line, "double")).alias("power"),
            F.when(method != "IDW", pick([8000.0, 16000.0, 20000.0, 24000.0, None], part + line, "double")).alias("lag_dist"),
            F.when(~fixed, pick([5, 12, 25, 50, 100], part, "long")).alias("num_points"),
            F.when(fixed, pick([16000.0, 40250.0, 80500.0, 161000.0], part, "double")).alias("distance"),
            F.when(fixed, pick([2, 6, 12, 24], supp + line, "long")).alias("f_pts"),
            (F.col("l_extendedprice") / 1000.0).alias("rmse"),
            (F.col("l_quantity") + F.col("l_discount")).alias("mae"),
            (F.col("l_quantity") * 10.0 + F.col("l_tax")).alias("seconds"),
        )
    )
