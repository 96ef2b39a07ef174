"""Censored Kendall / Theil-Sen trends and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import (
    case_chain,
    count_distinct_with_null,
    norm_cdf,
    numeric_grid,
    ratio,
    safe_log10,
    t_quantile,
)
from lodestat.operators.crossing import LIST_PAIRS, zero_crossing
from lodestat.operators.relate import attach, attach_stats, semi
from lodestat.operators.smooth import local_smooth  # noqa: F401
from lodestat.operators.survival import km_from_points
from lodestat.sources.files import stored


def eligible(df: DataFrame, keys, column: str, min_n: int = 3, distinct: bool = True) -> DataFrame:
    """Rows of groups with enough distinct (or merely non-missing) values of a column."""
    c = F.col(column)
    size = count_distinct_with_null(c) if distinct else F.count(c)
    kept = df.groupBy(*keys).agg(size.alias("_size")).filter(F.col("_size") >= min_n)
    return semi(df, stored(kept), list(keys))


def _tie_sums(points: DataFrame, keys, by, suffix: str) -> DataFrame:
    t = F.col("_t").cast("double")
    return (points.groupBy(*keys, by.alias("_by")).agg(F.sum("_w").alias("_t")).groupBy(*keys)
            .agg(F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_v{suffix}"),
                 F.sum(t * (t - 1) * (t - 2)).alias(f"_three{suffix}"),
                 F.sum(t * (t - 1)).alias(f"_two{suffix}"), F.sum(t).alias(f"_n{suffix}")))


def censored_trend(df: DataFrame, x: str = "year", keys=("parameter", "stream"),
                   value: str = "value", list_pairs: int = LIST_PAIRS) -> DataFrame:
    """Slope, intercept, tau and p of a left-censored value on ``x`` per group.

    The slope is where the Kendall sign sum of the residuals changes sign (see ``crossing``; a
    smaller ``list_pairs`` means more rounds, not another result); the intercept is the
    Kaplan-Meier median of the residuals; p is two-sided from the tie-corrected normal
    approximation with continuity correction, where non-detects form one tie group. Degenerate
    groups give nulls. Rows are first collapsed to weighted distinct points, which are stored
    once.
    """
    keys = list(keys)
    shown = F.when(F.col("below_mdl"), F.col("mdl")).otherwise(F.col(value))
    points = stored(
        df.select(*keys, F.col(x).cast("double").alias("_x"), shown.cast("double").alias("_y"),
                  F.col("below_mdl").alias("_c"))
        .filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
        .groupBy(*keys, "_x", "_y", "_c").agg(F.count(F.lit(1)).alias("_w")))
    slopes = stored(zero_crossing(points, keys, list_pairs))
    residuals = attach(points, slopes.filter("slope IS NOT NULL"), keys, "inner").withColumn(
        "_r", F.col("_y") - F.col("slope") * F.col("_x")).groupBy(*keys, "_r").agg(
        F.sum(F.when(~F.col("_c"), F.col("_w")).otherwise(F.lit(0))).alias("detects"),
        F.sum(F.when(F.col("_c"), F.col("_w")).otherwise(F.lit(0))).alias("censored"))
    medians = km_from_points(residuals, keys, "_r").select(*keys, F.col("median").alias("intercept"))
    ties = attach(_tie_sums(points, keys, F.col("_x"), "x"),
                  _tie_sums(points, keys, F.when(~F.col("_c"), F.col("_y")), "y"), keys)
    n = F.col("_nx")
    variance = ((n * (n - 1) * (2 * n + 5) - F.col("_vx") - F.col("_vy")) / 18
                + F.coalesce(ratio(F.col("_threex") * F.col("_threey"),
                                   9 * n * (n - 1) * (n - 2)), F.lit(0.0))
                + F.coalesce(ratio(F.col("_twox") * F.col("_twoy"), 2 * n * (n - 1)), F.lit(0.0)))
    tested = attach(attach(slopes, ties, keys), medians, keys).withColumns({
        "_sd": F.sqrt(F.when(variance > 1e-12 * n * n * n, variance))})
    size = F.greatest(F.abs(F.col("s_zero")) - 1, F.lit(0.0))
    return tested.select(
        *keys, "slope", "intercept", ratio(F.col("s_zero"), n * (n - 1) / 2).alias("tau"),
        ratio(size, F.col("_sd")).alias("_z"), n.cast("long").alias("n"),
    ).select(*keys, "slope", "intercept", "tau",
             F.when(F.col("_z").isNotNull(),
                    F.least(2 * (1 - norm_cdf(F.col("_z"))), F.lit(1.0))).alias("p"), "n")


def significant_trends(trends: DataFrame, alpha: float = 0.05, falling: bool = False) -> DataFrame:
    kept = trends.filter(F.col("p") < alpha)
    return kept.filter(F.col("slope") < 0) if falling else kept


def decadal_change(trends: DataFrame, means: DataFrame, keys=("parameter", "stream"),
                   mean: str = "grand_mean") -> DataFrame:
    """Change per ten years in percent of the group mean."""
    return attach(trends, means.select(*keys, mean), list(keys)).withColumn(
        "decadal_change", 100 * ratio(10 * F.col("slope"), F.col(mean)))


def change_classes(df: DataFrame, column: str = "decadal_change") -> DataFrame:
    """Signed class 1-4 at thresholds 0, 10, 50 and 100, and the signed log10 of the size."""
    c = F.col(column)
    limits = list(enumerate((0, 10, 50, 100), start=1))
    rules = [(c > t, i) for i, t in limits] + [(c < -t, -i) for i, t in limits]
    log = safe_log10(F.abs(c))
    return df.withColumns({"fill": case_chain(rules).cast("int"),
                           "log_change": F.when(c < 0, -log).otherwise(log)})


def proportional_change(trends: DataFrame, km: DataFrame, keys=("stream", "parameter")) -> DataFrame:
    """Decline relative to the Kaplan-Meier mean, with its log10."""
    change = ratio(-F.col("slope"), F.col("mean"))
    return attach(trends, km.select(*keys, "mean"), list(keys)).withColumns(
        {"pct_change": change, "log_change": safe_log10(change)})


def regression_facets(df: DataFrame, trends: DataFrame, x: str, y: str,
                      keys=("parameter", "stream")) -> DataFrame:
    """Points of the streams that have a regression, with the bounds of each parameter."""
    shown = semi(df, stored(trends.select(*keys)), list(keys))
    bounds = shown.groupBy("parameter").agg(
        F.min(x).cast("double").alias("x_min"), F.max(x).cast("double").alias("x_max"),
        (F.max(y) * 1.1).alias("y_max"))
    return attach_stats(shown, bounds, ["parameter"])


def regression_grid(trends: DataFrame, bounds: DataFrame, by: float = 0.1) -> DataFrame:
    """Regression line of each stream on a grid between the bounds of its parameter."""
    ranged = attach(trends, bounds, ["parameter"], "inner")
    grid = numeric_grid(ranged, F.col("x_min"), F.col("x_max"), by, "x")
    return grid.select("parameter", "stream", "x",
                       (F.col("x") * F.col("slope") + F.col("intercept")).alias("y"))


def loglog_regression(df: DataFrame, x: str, y: str, keys, level: float = 0.9) -> DataFrame:
    """Least squares of log10 y on log10 x: per point the fit and its confidence band."""
    keys = list(keys)
    lx, ly = F.col("_lx"), F.col("_ly")
    rows = df.withColumns({"_lx": safe_log10(F.col(x)), "_ly": safe_log10(F.col(y))}).filter(
        F.col("_lx").isNotNull() & F.col("_ly").isNotNull())
    fits = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(ly, lx).alias("slope"),
        F.regr_intercept(ly, lx).alias("intercept"), F.regr_sxx(ly, lx).alias("_sxx"),
        F.regr_syy(ly, lx).alias("_syy"), F.regr_sxy(ly, lx).alias("_sxy"),
        F.avg(lx).alias("_mx"))
    residual = F.greatest(F.col("_syy") - ratio(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")),
                          F.lit(0.0))
    fits = fits.withColumn("_s2", F.when(F.col("_n") > 2, ratio(residual, F.col("_n") - 2)))
    fits = stored(fits.withColumn("_t", t_quantile(level, F.col("_n") - 2)))
    away = F.col("_lx") - F.col("_mx")
    half = F.col("_t") * F.sqrt(
        F.col("_s2") * (ratio(F.lit(1), F.col("_n")) + ratio(away * away, F.col("_sxx"))))
    joined = attach(rows, fits, keys).withColumn(
        "_fit", F.col("intercept") + F.col("slope") * F.col("_lx"))
    return joined.withColumns({
        "fit": F.pow(F.lit(10.0), "_fit"), "lower": F.pow(F.lit(10.0), F.col("_fit") - half),
        "upper": F.pow(F.lit(10.0), F.col("_fit") + half),
    }).drop("_lx", "_ly", "_n", "_sxx", "_syy", "_sxy", "_mx", "_s2", "_t", "_fit")
