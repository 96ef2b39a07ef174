"""Storm against base flow: aligned domains, Gehan test, adjusted levels, ratio classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import (
    case_chain,
    count_distinct_with_null,
    norm_cdf,
    ratio,
    safe_log10,
    shift_months,
)
from lodestat.operators.ordered import running_totals
from lodestat.operators.relate import anti, attach_stats, bind_rows, semi
from lodestat.sources.files import stored

STORM, BASE = "wet weather", "Routine"


def align_domains(storm: DataFrame, base: DataFrame) -> DataFrame:
    """Storm rows in the base period (a month wider), on base streams and parameters; then base
    rows on the streams and parameters left.

    Key sets come from one aggregated pass over each side and are stored, as they are read
    several times.
    """
    keys = ["stream", "parameter"]
    covered = stored(base.groupBy(*keys).agg(F.min("date").alias("low"), F.max("date").alias("high")))
    bounds = covered.agg(shift_months(F.min("low"), -1).alias("low"),
                         shift_months(F.max("high"), 1).alias("high"))
    kept = storm.filter((F.col("date") >= bounds.select("low").scalar())
                        & (F.col("date") <= bounds.select("high").scalar()))
    for key in keys:
        kept = semi(kept, covered.select(key).distinct(), [key])
    left = stored(kept.select(*keys).distinct())
    matched = base
    for key in keys:
        matched = semi(matched, left.select(key).distinct(), [key])
    return bind_rows(kept, matched)


def prune_sparse(df: DataFrame, min_dates: int = 3) -> DataFrame:
    """Drop parameters without detects, then streams where an event type has few dates."""
    hidden = stored(df.groupBy("parameter").agg(F.bool_and("below_mdl").alias("_all"))
                    .filter("_all").select("parameter"))
    kept = anti(df, hidden, ["parameter"])
    few = stored(kept.groupBy("stream", "routine")
                 .agg(count_distinct_with_null(F.col("date")).alias("_dates"))
                 .filter(F.col("_dates") < min_dates).select("stream").distinct())
    return anti(kept, few, ["stream"])


def eligible_groups(df: DataFrame, keys, class_col: str, classes, min_n: int) -> DataFrame:
    """Groups in which every class has at least ``min_n`` rows."""
    counts = [F.count_if(F.col(class_col) == c) >= min_n for c in classes]
    every = counts[0]
    for c in counts[1:]:
        every = every & c
    return df.groupBy(*keys).agg(every.alias("_ok")).filter("_ok").select(*keys)


def gehan_test(df: DataFrame, keys=("parameter",), min_n: int = 3) -> DataFrame:
    """Gehan's generalised Wilcoxon test, storm against base, one-sided for storm above base.

    Only streams with enough rows of both event types take part. With ``stream`` among the keys
    the test is per stream. An observation's score is the number of observations surely below it
    minus the number surely above it; both are running counts over distinct values, so no pairs
    of rows are formed. The scores equal those on flipped, right-censored values with the sign
    reversed.
    """
    keys = list(keys)
    group = keys if "stream" in keys else [*keys, "stream"]
    rows = semi(df, stored(eligible_groups(df, group, "routine", (STORM, BASE), min_n)), group)
    storm, base = F.col("routine") == STORM, F.col("routine") == BASE
    below = F.col("below_mdl")
    shown = F.when(below, F.col("mdl")).otherwise(F.col("value"))
    known = shown.isNotNull()
    points = rows.groupBy(*keys, F.coalesce(shown, F.lit(0.0)).alias("_y")).agg(
        F.count_if(storm & known & ~below).alias("_w1"),
        F.count_if(storm & known & below).alias("_w0"),
        F.count_if(base & known & ~below).alias("_b1"),
        F.count_if(base & known & below).alias("_b0"),
        *[c for name, held in (("wet", storm), ("routine", base)) for c in (
            F.sum(F.when(held, F.col("rvalue"))).alias(f"_sum_{name}"),
            F.count(F.when(held, F.col("rvalue"))).alias(f"_valued_{name}"),
            F.count_if(held).alias(f"_rows_{name}"),
            F.count_if(held & below).alias(f"_below_{name}"))])
    points = points.withColumns({
        "_detects": F.col("_w1") + F.col("_b1"),
        "_any": F.col("_w1") + F.col("_b1") + F.col("_w0") + F.col("_b0")})
    seen = running_totals(points, keys, "_y", ["_detects", "_any"])
    # As doubles: squares outgrow integers. A non-detect at y lies surely below a detect at y.
    held = F.col("_any") - F.col("_detects")
    lower, higher = F.col("_any_before") + held, F.col("_detects_all") - F.col("_detects_before")
    u1 = (lower - (higher - F.col("_detects"))).cast("double")
    u0 = (-higher).cast("double")
    sums = seen.groupBy(*keys).agg(
        F.sum(F.col("_w1") * u1 + F.col("_w0") * u0).alias("_w"),
        F.sum(F.col("_detects") * u1 * u1 + held * u0 * u0).alias("_u2"),
        F.sum((F.col("_w1") + F.col("_w0")).cast("double")).alias("_n1"),
        F.sum((F.col("_b1") + F.col("_b0")).cast("double")).alias("_n2"),
        *[c for name in ("wet", "routine") for c in (
            ratio(F.sum(f"_sum_{name}"), F.sum(f"_valued_{name}")).alias(f"mean_{name}"),
            ratio(100 * F.sum(f"_below_{name}"), F.sum(f"_rows_{name}")).alias(f"censored_{name}"))])
    n1, n2 = F.col("_n1"), F.col("_n2")
    variance = ratio(n1 * n2 * F.col("_u2"), (n1 + n2) * (n1 + n2 - 1))
    tested = sums.withColumn("gehan_stat", ratio(F.col("_w"), F.sqrt(variance)))
    return tested.select(*keys, "mean_wet", "mean_routine", "gehan_stat",
                         (1 - norm_cdf(F.col("gehan_stat"))).alias("p"),
                         "censored_wet", "censored_routine")


def sidak_level(tests: DataFrame, condition, alpha: float = 0.05) -> DataFrame:
    """One row: number of tests meeting the condition and the level adjusted for them."""
    counted = tests.agg(F.count_if(condition).alias("tests"))
    return counted.select("tests", F.when(F.col("tests") == 0, F.lit(1.0)).otherwise(
        1 - F.pow(F.lit(1.0 - alpha), ratio(F.lit(1), F.col("tests")))).alias("level"))


def flag_significant(tests: DataFrame, level: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Flags at the adjusted level and at ``alpha``, only where storm exceeds base."""
    higher = F.col("mean_wet") > F.col("mean_routine")
    return tests.withColumns({"sig": (F.col("p") < level.select("level").scalar()) & higher,
                              "pseudosig": (F.col("p") < alpha) & higher})


def gehan_by_stream(df: DataFrame, overall: DataFrame) -> DataFrame:
    """Per-stream tests; the level counts only parameters significant overall."""
    tests = gehan_test(df, ["stream", "parameter"])
    tests = stored(tests)
    significant = overall.filter("sig").select("parameter")
    counted = semi(tests.filter(F.col("p").isNotNull()), significant, ["parameter"])
    level = sidak_level(counted, F.col("mean_wet") > F.col("mean_routine"))
    return flag_significant(tests, level).withColumn(
        "storm_base_ratio", ratio(F.col("mean_wet"), F.col("mean_routine")))


def ratio_classes(df: DataFrame, column: str = "storm_base_ratio") -> DataFrame:
    """Class 1-4 of a ratio at thresholds 1, 2, 5 and 10, and its log10."""
    c = F.col(column)
    return df.withColumns({
        "fill": case_chain([(c > t, i) for i, t in enumerate((1, 2, 5, 10), start=1)]).cast("int"),
        "log_ratio": safe_log10(c)})


def bonferroni_filter(tests: DataFrame, k: int, alpha: float = 0.05) -> DataFrame:
    """Declines significant after dividing the level by ``k`` tests."""
    return tests.filter((F.col("slope") < 0) & (F.col("p") < alpha / k))


def baseline_points(df: DataFrame, parameter: str | None = None) -> DataFrame:
    """Points of the baseline comparison with the axis maximum of each parameter."""
    rows = df if parameter is None else df.filter(F.col("parameter") == parameter)
    tops = rows.groupBy("parameter").agg((F.max("rvalue") * 1.05).alias("y_max"))
    return attach_stats(rows, tops, ["parameter"]).select(
        "parameter", "stream", "date", "routine", "below_mdl", "mdl", "rvalue", "y_max")
