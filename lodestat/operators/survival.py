"""Kaplan-Meier summaries of left-censored groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import ratio, safe_log10
from lodestat.operators.ordered import marks, running_totals, sliced
from lodestat.operators.relate import full_join

# Probabilities are sums of logarithms; one half is met up to this.
SLACK = 1e-9


def km_points(points: DataFrame, keys, value: str = "cvalue") -> DataFrame:
    """Distribution steps from (keys, value, detects, censored) counts.

    ``_cdf`` is the probability of a value at or below the row's value, ``_mass`` the
    probability on it, ``_rest`` the probability left below the smallest detect.
    """
    cut = sliced(points.withColumn("_all", F.col("detects") + F.col("censored")), keys, value)
    at_risk = running_totals(cut, keys, value, ["_all"], cut=False)
    share = ratio(F.col("detects"), F.col("_all_before") + F.col("_all"))
    # A factor of zero can only be the smallest value of the group; it is kept as a flag.
    steps = at_risk.select(
        *keys, value, "detects", "censored", share.alias("_share"),
        F.when(share < 1, F.ln(1 - share)).otherwise(F.lit(0.0)).alias("_log"),
        (share >= 1).cast("int").alias("_zero"), *marks(at_risk))
    scored = running_totals(steps, keys, value, ["_log", "_zero"], cut=False)
    above = F.exp(F.col("_log_all") - F.col("_log_before") - F.col("_log"))
    rest = F.when(F.col("_zero_all") > 0, F.lit(0.0)).otherwise(F.exp("_log_all"))
    return scored.select(*keys, value, "detects", "censored", above.alias("_cdf"),
                         (above * F.col("_share")).alias("_mass"), rest.alias("_rest"))


def km_from_points(points: DataFrame, keys, value: str = "cvalue") -> DataFrame:
    """Mean, median, SD and counts per group from weighted (value, detects, censored) points."""
    steps = km_points(points, keys, value)
    v, mass = F.col(value), F.col("_mass")
    sums = steps.groupBy(*keys).agg(
        F.sum(v * mass).alias("_m1"), F.sum(v * v * mass).alias("_m2"),
        F.min(v).alias("_least"), F.max("_rest").alias("_rest"),
        F.min(F.when((F.col("detects") > 0) & (F.col("_cdf") >= 0.5 - SLACK), v)).alias("_med"),
        F.sum("detects").alias("_d"), F.sum("censored").alias("_c"))
    mean = F.col("_m1") + F.col("_rest") * F.col("_least")
    second = F.col("_m2") + F.col("_rest") * F.col("_least") * F.col("_least")
    return sums.withColumn("mean", mean).select(
        *keys, "mean",
        F.when(F.col("_rest") <= 0.5 + SLACK, F.col("_med")).alias("median"),
        F.sqrt(F.greatest(second - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"),
        (F.col("_d") + F.col("_c")).alias("n"), F.col("_c").alias("n_censored"),
        (F.col("_d") == 0).alias("all_censored"))


def weighted_points(df: DataFrame, keys, value: str = "value", name: str = "cvalue") -> DataFrame:
    """Counts of detects and non-detects per distinct censored value."""
    shown = F.when(F.col("below_mdl"), F.col("mdl")).otherwise(F.col(value))
    return (df.select(*keys, shown.alias(name), "below_mdl").filter(F.col(name).isNotNull())
            .groupBy(*keys, name).agg(
                F.count_if(~F.col("below_mdl")).alias("detects"),
                F.count_if(F.col("below_mdl")).alias("censored")))


def km_summary(df: DataFrame, keys=("stream", "parameter"), value: str = "value") -> DataFrame:
    """Kaplan-Meier mean, median and SD per group.

    What probability remains below the smallest detect goes to the smallest observation; the
    median is null where more than half of the probability remains there.
    """
    return km_from_points(weighted_points(df, keys, value), list(keys))


def km_table(km: DataFrame) -> DataFrame:
    """Means hidden where everything is censored, with their log10."""
    mean = F.when(~F.col("all_censored"), F.col("mean"))
    return km.withColumns({"mean": mean, "log_mean": safe_log10(mean)})


def compare_means(km: DataFrame, means: DataFrame, keys=("stream", "parameter"),
                  mean: str = "grand_mean", tolerance: float = 0.1) -> DataFrame:
    """Groups whose Kaplan-Meier mean differs from the substitution mean by more than 10 %."""
    both = full_join(means, km, list(keys))
    low, high = F.col(mean) * (1 - tolerance), F.col(mean) * (1 + tolerance)
    return both.filter((F.col("mean") != 0)
                       & ((F.col("mean") < low) | (F.col("mean") > high)))
