"""Dissolved and particulate fractions, and their relation to dissolved oxygen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import clamp, ratio, stream_label
from lodestat.operators.prep import pair_fractions
from lodestat.operators.relate import attach_covariate

# Field oxygen measurements are stored under this parameter name.
OXYGEN_NAME = "Dissolved Oxygen, Field"


def oxygen_readings(df: DataFrame, parmname: str = OXYGEN_NAME) -> DataFrame:
    """Oxygen readings by place and date."""
    return df.filter(F.col("parmname") == parmname).select(
        "locator", "date", F.col("value").alias("do"))


def partition_fractions(df: DataFrame) -> DataFrame:
    """Dissolved and total of the same metal, place and date, percent dissolved, censor flag."""
    pairs = pair_fractions(df, ["date", "locator", "stream"],
                           ["sample", "parameter", "value", "below_mdl", "rvalue"])
    return pairs.withColumns({
        "pct_dissolved": 100 * ratio(F.col("rvalue_d"), F.col("rvalue_t")),
        "below_mdl": F.col("below_mdl_d") | F.col("below_mdl_t")})


def uncensored(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("below_mdl"))


def oxygen_partition(pairs: DataFrame, oxygen: DataFrame) -> DataFrame:
    """Uncensored percent dissolved, at most 100, beside oxygen of the same place and date."""
    return attach_covariate(uncensored(pairs), oxygen).withColumn(
        "pct_dissolved", clamp(F.col("pct_dissolved"), 100.0))


def oxygen_points(df: DataFrame, oxygen: DataFrame) -> DataFrame:
    """Measurements with oxygen and a short stream label."""
    return attach_covariate(df, oxygen).withColumn("label", stream_label(F.col("stream")))
