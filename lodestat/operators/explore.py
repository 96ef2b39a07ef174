"""Scaling, ranks, Q-Q points, box statistics and the data behind the usual charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import (
    detect,
    lognorm_quantile,
    norm_quantile,
    numeric_grid,
    ratio,
    round_half_even,
    safe_log10,
    stream_label,
)
from lodestat.operators.ordered import (
    alphabetical_rank,
    exact_quantiles,
    group_median,
    ordinal_positions,
    rank_categories,
)
from lodestat.operators.relate import attach, attach_stats, bind_rows
from lodestat.sources.files import stored


def zscore(df: DataFrame, by, value: str, name: str = "scaled") -> DataFrame:
    """Value centred and divided by the sample SD of its group; null for a constant group."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return attach_stats(df, stats, list(by)).withColumn(
        name, ratio(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def minmax(df: DataFrame, by, value: str, name: str = "scaled") -> DataFrame:
    """Value mapped to [0, 1] within its group; 0.5 for a constant group."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    return attach_stats(df, ends, list(by)).withColumn(
        name, F.when(F.col(value).isNull(), F.lit(None)).when(hi == lo, F.lit(0.5))
        .otherwise(ratio(F.col(value) - lo, hi - lo))).drop("_lo", "_hi")


def ratio_to_group_mean(df: DataFrame, by=("parameter",), value: str = "grand_mean",
                        name: str = "scaled") -> DataFrame:
    """Value relative to the mean of its group."""
    means = df.groupBy(*by).agg(F.avg(value).alias("group_mean"))
    return attach_stats(df, means, list(by)).withColumn(name, ratio(F.col(value), F.col("group_mean")))


def heatmap_cells(df: DataFrame, x: str = "stream", y: str = "parameter", value: str = "value",
                  method: str = "scale", label: str | None = None, label_digits: int = 0,
                  grey: str | None = None, reverse: bool = False, reorder_x: bool = True,
                  reorder_y: bool = False) -> DataFrame:
    """Cells of a heatmap: scaled value, axis ranks, rounded label, grey mask."""
    v = -F.col(value) if reverse else F.col(value)
    shown = v if label == value else (F.col(label) if label else F.lit(None).cast("double"))
    cells = df.select(
        F.col(x).alias("x"), F.col(y).alias("y"), v.alias("value"),
        round_half_even(shown.cast("double"), label_digits).alias("label"),
        (F.coalesce(F.col(grey), F.lit(False)) if grey else F.lit(False)).alias("grey"))
    if method == "scale":
        cells = zscore(cells, ["y"], "value", "value").filter(
            F.col("value").isNotNull() | F.col("grey"))
    elif method == "rescale":
        cells = minmax(cells, ["y"], "value", "value").filter(
            F.col("value").isNotNull() | F.col("grey"))
    cells = stored(cells)
    for axis, reorder in (("x", reorder_x), ("y", reorder_y)):
        name = f"{axis}_rank"
        ranks = (rank_categories(cells, axis, "value", name) if reorder
                 else alphabetical_rank(cells, axis, name))
        cells = attach(cells, ranks.select(axis, name), [axis])
    return cells


def qq_points(df: DataFrame, keys=("parameter",), value: str = "mean", dist: str = "norm",
              label: str = "stream") -> DataFrame:
    """Sorted sample against normal or log-normal quantiles, with a short label.

    Plotting position (i - a) / (n + 1 - 2a) with a = 3/8 up to ten points, else 1/2.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, label, F.col(value).alias("sample"))
    ranked = ordinal_positions(rows, keys, "sample", [label])
    a = F.when(F.col("group_size") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    ranked = ranked.withColumn("_p", (F.col("position") - a) / (F.col("group_size") + 1 - 2 * a))
    quantile = norm_quantile if dist == "norm" else lognorm_quantile
    return ranked.select(*keys, label, stream_label(F.col(label)).alias("label"), "position",
                         "sample", quantile(F.col("_p")).alias("theoretical"))


def outlier_fences(df: DataFrame, keys=("parameter",), value: str = "mean") -> DataFrame:
    """Upper quartile plus 1.5 and 3 interquartile ranges."""
    q = exact_quantiles(df, list(keys), value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return q.select(*keys, "q1", "q3", (F.col("q3") + 1.5 * spread).alias("fence"),
                    (F.col("q3") + 3 * spread).alias("far_fence"))


def box_stats(df: DataFrame, keys, value: str, log: bool = False) -> DataFrame:
    """Quartiles, whisker ends inside 1.5 IQR and number of outliers per group."""
    keys = list(keys)
    shown = safe_log10(F.col(value)) if log else F.col(value)
    rows = df.select(*keys, shown.alias("_v")).filter(F.col("_v").isNotNull())
    q = exact_quantiles(rows, keys, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return attach_stats(rows, q, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"),
        F.max("q3").alias("q3"), F.min(F.when(inside, F.col("_v"))).alias("lower"),
        F.max(F.when(inside, F.col("_v"))).alias("upper"), F.count_if(~inside).alias("outliers"))


def box_outliers(df: DataFrame, keys, value: str) -> DataFrame:
    """Rows beyond 1.5 IQR of their group's quartiles."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    return attach_stats(df, q, keys).filter(
        (F.col(value) < F.col("_q1") - reach) | (F.col(value) > F.col("_q3") + reach)
    ).drop("_q1", "_q3")


def annual_summary(df: DataFrame, keys=("stream", "parameter"), mdl: str = "max") -> DataFrame:
    """Annual mean, median or maximum limit, high-non-detect flag and mid-year date.

    The flag is true only for years consisting of high non-detects alone; a year with any
    detect has no flag at all and counts as not flagged.
    """
    keys = [*keys, "year"]
    high = F.count_if(detect(F.col("rvqual"), "HighNonDetect", literal=True))
    yearly = df.groupBy(*keys).agg(
        F.avg("rvalue").alias("annual_mean"), F.max("mdl").alias("mdl"),
        (high == F.count(F.lit(1))).alias("high_non_detect"))
    if mdl == "median":
        yearly = attach(yearly.drop("mdl"), group_median(df, keys, "mdl", "mdl"), keys)
    return yearly.withColumn("date", F.make_date(F.col("year"), F.lit(7), F.lit(1)))


def other_locations(storm: DataFrame, base: DataFrame, core: str = "FDL") -> DataFrame:
    """Storm and base rows of all locations outside the core group."""
    return bind_rows(storm, base).filter(F.col("loc_group") != core)


def lower_mean_points(df: DataFrame, below: float = 1000.0) -> DataFrame:
    """Limit against replacement where a non-detect was replaced by a mean of lower data."""
    return df.filter(detect(F.col("rvqual"), "LowerMean", literal=True)
                     & (F.col("mdl") < below)).select(
        "stream", "parameter", "date", "locator", "mdl", "replacement")


def guide_lines(points: DataFrame, by: float = 0.01, low: float = 0.001) -> DataFrame:
    """Lines y = x and y = x/2 over the range of limits in the points."""
    top = points.agg(F.max("mdl").alias("_high")).filter(F.col("_high").isNotNull())
    grid = numeric_grid(top, F.lit(low), F.col("_high"), by, "x")
    return grid.select("x", F.col("x").alias("y"), (F.col("x") / 2).alias("half"))


def parameter_maxima(df: DataFrame) -> DataFrame:
    """Axis maximum per parameter."""
    return df.groupBy("parameter").agg((F.max("rvalue") * 1.1).alias("y_max"))
