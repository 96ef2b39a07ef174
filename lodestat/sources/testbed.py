"""Measurement tables derived from the order/line-item test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.sources.files import stored

METALS = {"ECONOMY": "Copper", "SMALL": "Lead", "MEDIUM": "Nickel", "PROMO": "Zinc",
          "STANDARD": "Iron", "LARGE": "Cadmium"}
# Detection limit by line tax in percent.
LIMITS = ((1, 1.0), (3, 4.0), (5, 10.0), (7, 20.0), (8, 60.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detection_limit() -> Column:
    percent = F.round(F.col("l_tax") * 100).cast("int")
    limit = F.lit(LIMITS[-1][1])
    for top, mdl in reversed(LIMITS[:-1]):
        limit = F.when(percent <= top, F.lit(mdl)).otherwise(limit)
    return limit


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by supplier, stored so that the join of the rows with them knows their size."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return stored(supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        "s_suppkey", F.col("s_name").alias("locator"), F.col("n_name").alias("stream"),
        F.concat(F.lit("P"), F.col("n_regionkey")).alias("position"),
        F.when(F.col("n_regionkey") % 2 == 0, "FDL").otherwise("Other").alias("loc_group")))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical measurements: one row per line item, about a fifth below the limit."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    metal = F.lit(None)
    for kind, name in METALS.items():
        metal = F.when(F.col("p_type") == kind, F.lit(name)).otherwise(metal)
    fraction = F.when(F.col("l_linestatus") == "F", ", Total").otherwise(", Dissolved")
    day = F.to_date("l_shipdate")
    rows = line.join(part, line.l_partkey == part.p_partkey).join(
        _sites(spark, sf_dir), line.l_suppkey == F.col("s_suppkey")
    ).withColumn("mdl", detection_limit()).withColumn("quantity", F.col("l_quantity"))
    detected = F.col("quantity") >= F.col("mdl")
    return rows.select(
        F.concat(F.lit("L"), F.col("l_orderkey")).alias("sample"),
        day.alias("date"), F.year(day).alias("year"), F.month(day).alias("month"),
        F.when(F.col("l_returnflag") == "R", "Routine").otherwise("wet weather").alias("routine"),
        "locator", "stream", "position", "loc_group", F.lit("Metal").alias("metal_org"),
        F.concat(metal, fraction).alias("parameter"),
        F.concat(metal, F.lit(", ICP")).alias("parmname"),
        F.when(detected, F.col("quantity")).alias("value"), F.lit("ug/L").alias("units"),
        F.when(~detected, "<MDL").when(F.col("quantity") < 2 * F.col("mdl"), "<RDL").alias("qual"),
        "mdl", (2 * F.col("mdl")).alias("rdl"), F.col("p_brand").alias("textvalue"),
        (F.col("l_extendedprice") / 1000).alias("hardness"))


def oxygen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oxygen covariate by place and date, from the first line of each order."""
    line = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    sites = _sites(spark, sf_dir).select("s_suppkey", "locator")
    return line.join(sites, line.l_suppkey == sites.s_suppkey).select(
        "locator", F.to_date("l_shipdate").alias("date"),
        (F.lit(4.0) + F.round(F.col("l_discount") * 100)).alias("do"))


def chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calcium, magnesium and laboratory hardness rows by sample."""
    parameter = (F.when(F.col("l_linenumber") == 1, "Calcium, Total")
                 .when(F.col("l_linenumber") == 2, "Magnesium, Total")
                 .when(F.col("l_linenumber") == 3, "Calcium, Dissolved")
                 .when(F.col("l_linenumber") == 4, "Magnesium, Dissolved")
                 .when(F.col("l_linenumber") == 5, "Hardness")
                 .otherwise("Copper, Total"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("L"), F.col("l_orderkey")).alias("sample"),
        F.lit("1999-01-01").cast("date").alias("date"),
        parameter.alias("parameter"),
        F.when(parameter == "Hardness", "Hardness, Calc").otherwise(parameter).alias("parmname"),
        (F.col("l_quantity") * 1000).alias("value"))
