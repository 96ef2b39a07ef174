"""Regulatory criteria: hardness-dependent limits, ratios, exceedances, summaries, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import r_isin, r_not_isin, ratio, round_half_even, safe_ln
from lodestat.operators.ordered import exact_quantiles
from lodestat.operators.relate import attach, attach_stats, semi
from lodestat.sources.files import stored

KINDS = ("acute", "chronic", "water")

# A limit is either `fixed`, or (c0 - c1 ln H) exp(m ln H + b) of hardness H.
CRITERIA_COLUMNS = ("parameter string, kind string, c0 double, c1 double, m double, b double, "
                    "fixed double")
CRITERIA = [
    ("Antimony, Total", "water", None, None, None, None, 6.0),
    ("Arsenic, Dissolved", "acute", None, None, None, None, 360.0),
    ("Arsenic, Dissolved", "chronic", None, None, None, None, 190.0),
    ("Arsenic, Total", "water", None, None, None, None, 0.018 / 0.8),
    ("Mercury, Dissolved", "acute", None, None, None, None, 2.1),
    ("Mercury, Total", "chronic", None, None, None, None, 0.012),
    ("Mercury, Total", "water", None, None, None, None, 0.14),
    ("Selenium, Total", "acute", None, None, None, None, 20.0),
    ("Selenium, Total", "chronic", None, None, None, None, 5.0),
    ("Selenium, Total", "water", None, None, None, None, 60.0),
    ("Thallium, Total", "water", None, None, None, None, 0.24),
    ("Cadmium, Dissolved", "acute", 1.136672, 0.041838, 1.128, -3.828, None),
    ("Cadmium, Dissolved", "chronic", 1.101672, 0.041838, 0.7852, -3.490, None),
    ("Chromium, Total", "acute", 0.316, 0.0, 0.8190, 3.688, None),
    ("Chromium, Total", "chronic", 0.860, 0.0, 0.8190, 1.561, None),
    ("Copper, Dissolved", "acute", 0.960, 0.0, 0.9422, -1.464, None),
    ("Copper, Dissolved", "chronic", 0.960, 0.0, 0.8545, -1.465, None),
    ("Copper, Total", "water", None, None, None, None, 1300.0),
    ("Lead, Dissolved", "acute", 1.46203, 0.145712, 1.273, -1.460, None),
    ("Lead, Dissolved", "chronic", 1.46203, 0.145712, 1.273, -4.705, None),
    ("Nickel, Dissolved", "acute", 0.998, 0.0, 0.8460, 3.3612, None),
    ("Nickel, Dissolved", "chronic", 0.997, 0.0, 0.8460, 1.1645, None),
    ("Nickel, Total", "water", None, None, None, None, 80.0),
    ("Silver, Dissolved", "acute", 0.85, 0.0, 1.72, -6.52, None),
    ("Zinc, Dissolved", "acute", 0.978, 0.0, 0.8473, 0.8604, None),
    ("Zinc, Dissolved", "chronic", 0.986, 0.0, 0.8473, 0.7614, None),
    ("Zinc, Total", "water", None, None, None, None, 1000.0),
]

# Parameters reported as hardness-dependent (silver is not among them).
HARDNESS_DEPENDENT = [
    "Cadmium, Dissolved",
    "Chromium, Total",
    "Copper, Dissolved",
    "Lead, Dissolved",
    "Nickel, Dissolved",
    "Zinc, Dissolved",
]


def criteria_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(CRITERIA if rows is None else rows, CRITERIA_COLUMNS)


def attach_criteria(df: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``acute``, ``chronic`` and ``water`` limits; null where none is set."""
    cells = ("fixed", "c0", "c1", "m", "b")
    wide = table.groupBy("parameter").agg(*[
        F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"_{k}_{c}")
        for k in KINDS for c in cells])
    ln_h = safe_ln(F.col("hardness"))

    def limit(k: str) -> Column:
        c0, c1, m, b = (F.col(f"_{k}_{c}") for c in cells[1:])
        return F.coalesce(F.col(f"_{k}_fixed"), (c0 - c1 * ln_h) * F.exp(m * ln_h + b)).alias(k)

    joined = df.join(stored(wide), "parameter", "left")  # a measured size: rows are not shuffled to meet it
    return joined.select(*df.columns, *[limit(k) for k in KINDS])


def exceedance_ratios(df: DataFrame) -> DataFrame:
    """Measured value relative to each limit."""
    return df.withColumns({f"prop_{k}": ratio(F.col("rvalue"), F.col(k)) for k in KINDS})


def exceedances(df: DataFrame, kind: str) -> DataFrame:
    """Detects above the aquatic (acute or chronic) or human-health limit."""
    if kind == "aquatic":
        above = (F.col("prop_acute") > 1) | (F.col("prop_chronic") > 1)
    else:
        above = F.col("prop_water") > 1
    return df.filter(above & ~F.col("below_mdl"))


def exceedance_rates(df: DataFrame, keys=("parameter",)) -> DataFrame:
    """Counts and percentages above each limit for groups with any exceedance.

    A non-detect counts as a sample only if its detection limit is below the criterion.
    """
    detected = ~F.col("below_mdl")
    counts = []
    for k in KINDS:
        counts += [F.count_if((F.col("mdl") < F.col(k)) | detected).alias(f"{k}_n"),
                   F.count_if((F.col(f"prop_{k}") > 1) & detected).alias(f"{k}_over")]
    rates = df.groupBy(*keys).agg(*counts)
    shown = []
    for k in KINDS:
        over, n = F.col(f"{k}_over"), F.col(f"{k}_n")
        shown += [n, over, ratio(over * 100, n).alias(f"{k}_pct")]
    return rates.filter(
        F.col("acute_over") + F.col("chronic_over") + F.col("water_over") > 0
    ).select(*keys, *shown)


def criteria_summary(df: DataFrame, parameters=tuple(HARDNESS_DEPENDENT)) -> DataFrame:
    """Minimum, median, mean and maximum of the hardness-dependent limits."""
    rows = df.filter((F.col("acute").isNotNull() | F.col("chronic").isNotNull())
                     & r_isin(F.col("parameter"), parameters))
    kinds = ("acute", "chronic")
    plain = rows.groupBy("parameter").agg(*[
        f(k).alias(f"{name}_{k}") for k in kinds
        for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])
    long = rows.select("parameter", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("limit")) for k in kinds])).alias("_k")
    ).select("parameter", "_k.*")
    medians = exact_quantiles(long, ["parameter", "kind"], "limit", {"median": 0.5}).groupBy(
        "parameter").agg(*[F.max(F.when(F.col("kind") == k, F.col("median"))).alias(f"median_{k}")
                           for k in kinds])
    return attach(plain, medians, ["parameter"])


def fixed_criteria(df: DataFrame, hardness_dependent=tuple(HARDNESS_DEPENDENT)) -> DataFrame:
    """Distinct limits of the parameters not listed as hardness-dependent."""
    return df.filter(
        r_not_isin(F.col("parameter"), hardness_dependent)
        & (F.col("acute").isNotNull() | F.col("chronic").isNotNull() | F.col("water").isNotNull())
    ).select("parameter", *KINDS).distinct()


def criteria_pair(df: DataFrame, mode: str) -> DataFrame:
    """Two role columns: acute and chronic, or the human-health limit twice."""
    if mode == "aquatic":
        return df.withColumnsRenamed({"acute": "crit1", "chronic": "crit2"})
    if mode == "human":
        return df.withColumnRenamed("water", "crit2").withColumn("crit1", F.col("crit2"))
    raise ValueError(f"unknown mode {mode!r}")


def criteria_points(df: DataFrame, mode: str = "aquatic", parameter: str | None = None) -> DataFrame:
    """Storm points that can be judged, for streams with any exceedance, with axis limits."""
    rows = criteria_pair(df, mode)
    if parameter is not None:
        rows = rows.filter(F.col("parameter") == parameter)
    c1, c2, below = F.col("crit1"), F.col("crit2"), F.col("below_mdl")
    rows = rows.filter((F.col("routine") == "wet weather")
                       & ((F.col("mdl") < c1) | (F.col("mdl") < c2) | ~below))
    prop1, prop2 = ratio(F.col("rvalue"), c1), ratio(F.col("rvalue"), c2)
    rows = rows.withColumns({
        "prop1": prop1, "prop2": prop2,
        "above_criteria": ~below & F.coalesce((prop1 > 1) | (prop2 > 1), F.lit(False))})
    shown = semi(rows, stored(rows.filter("above_criteria").select("parameter", "stream").distinct()),
                 ["parameter", "stream"])
    axes = shown.groupBy("parameter").agg(
        (F.max("rvalue") * 1.1).alias("y_max"),
        F.least(F.min("rvalue") * 0.9, F.min("crit2") * 0.9).alias("y_min"))
    return attach_stats(shown, axes, ["parameter"])


def report_table(name: str, df: DataFrame) -> DataFrame:
    """Numbers of a printed table, rounded half to even.

    ``fixed`` takes :func:`fixed_criteria`, ``hardness`` takes :func:`criteria_summary`, and
    ``aquatic`` and ``human`` take :func:`exceedance_rates` by parameter.
    """
    def rounded(digits: int, *columns: str):
        return [round_half_even(F.col(c), digits).alias(c) for c in columns]

    if name == "fixed":
        return df.select("parameter", *rounded(3, *KINDS))
    if name == "hardness":
        return df.select("parameter", *rounded(
            2, "min_acute", "median_acute", "max_acute",
            "min_chronic", "median_chronic", "max_chronic"))
    if name == "aquatic":
        return df.filter(F.col("acute_over") + F.col("chronic_over") > 0).select(
            "parameter", "acute_over", *rounded(1, "acute_pct"),
            "chronic_over", *rounded(1, "chronic_pct"))
    if name == "human":
        return df.filter(F.col("water_over") > 0).select(
            "parameter", "water_over", *rounded(1, "water_pct"))
    raise ValueError(f"unknown table {name!r}")
