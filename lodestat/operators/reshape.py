"""Long-wide reshaping and values beside a reference element of the same sample or site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions import detect, r_isin, r_not_isin, ratio
from lodestat.operators.relate import attach

# Metals that vary with iron.
IRON_CORRELATED = [
    "Aluminum, Total",
    "Arsenic, Total",
    "Barium, Total",
    "Cadmium, Total",
    "Chromium, Total",
    "Cobalt, Total",
    "Copper, Total",
    "Lead, Total",
    "Manganese, Total",
    "Mercury, Total",
    "Nickel, Total",
    "Vanadium, Total",
    "Zinc, Total",
]


def _single(value: Column, on_duplicate: str) -> Column:
    """One value per cell: the mean, or an error where several rows share a cell."""
    if on_duplicate == "mean":
        return F.avg(value)
    if on_duplicate != "error":
        raise ValueError(f"unknown duplicate rule {on_duplicate!r}")
    return F.when(F.count(F.lit(1)) > 1,
                  F.raise_error(F.lit("more than one row for a cell")).cast("double")
                  ).otherwise(F.max(value))


def pivot_parameters(df: DataFrame, ids, key: str, value: str, names,
                     on_duplicate: str = "error") -> DataFrame:
    """Long to wide over declared parameter names."""
    cells = df.filter(r_isin(F.col(key), names)).groupBy(*ids, key).agg(
        _single(F.col(value), on_duplicate).alias("_v"))
    return cells.groupBy(*ids).pivot(key, list(names)).agg(F.max("_v"))


def unpivot_parameters(df: DataFrame, ids, columns, key: str = "parameter", value: str = "value",
                       drop_null: bool = False) -> DataFrame:
    """Wide to long, optionally without missing cells."""
    long = df.unpivot(list(ids), [F.col(f"`{c}`") for c in columns], key, value)
    return long.filter(F.col(value).isNotNull()) if drop_null else long


def across(df: DataFrame, columns, fn) -> DataFrame:
    """Apply one expression to many columns."""
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in columns})


def group_mean(df: DataFrame, keys=("stream", "parameter"), column: str = "rvalue",
               name: str = "grand_mean", keep_missing: bool = False) -> DataFrame:
    """Mean per group ignoring missing values; groups without any value are dropped."""
    means = df.groupBy(*keys).agg(F.avg(column).alias(name))
    return means if keep_missing else means.filter(F.col(name).isNotNull())


def reference_pairs(df: DataFrame, references, ids=("sample", "date", "stream"),
                    value: str = "value", parameters=None,
                    on_duplicate: str = "error") -> DataFrame:
    """Each parameter's value (y) beside the same sample's reference values (x), both present."""
    cells = df.groupBy(*ids, "parameter").agg(_single(F.col(value), on_duplicate).alias("y"))
    cells = cells.filter(F.col("y").isNotNull())
    norm = cells.filter(r_isin(F.col("parameter"), references)).select(
        *ids, F.col("parameter").alias("norm"), F.col("y").alias("x"))
    others = cells.filter(r_not_isin(F.col("parameter"), references))
    if parameters is not None:
        others = others.filter(r_isin(F.col("parameter"), parameters))
    return attach(others, norm, list(ids), "inner").select(*ids, "parameter", "norm", "x", "y")


def ratio_to_reference(df: DataFrame, level: str = "sample", reference: str = "Iron, Total",
                       value: str | None = None, parameters=tuple(IRON_CORRELATED),
                       on_duplicate: str = "error") -> DataFrame:
    """Value relative to the reference element of the same sample or of the same stream."""
    ids = ["sample", "date", "stream"] if level == "sample" else ["stream"]
    value = value or ("value" if level == "sample" else "grand_mean")
    rows = df if level == "sample" else df.filter(
        detect(F.col("parameter"), "Total", literal=True))
    pairs = reference_pairs(rows, [reference], ids, value, parameters, on_duplicate)
    return pairs.select(*ids, "parameter", ratio(F.col("y"), F.col("x")).alias("ratio")).filter(
        F.col("ratio").isNotNull())


def km_iron_ratio(km: DataFrame, reference: str = "Iron, Total",
                  parameters=tuple(IRON_CORRELATED)) -> DataFrame:
    """Kaplan-Meier site means relative to iron.

    A fully censored metal is hidden; a fully censored iron is not.
    """
    ratios = ratio_to_reference(km, "stream", reference, "mean", parameters)
    keys = ["stream", "parameter"]
    joined = attach(ratios, km.select(*keys, "all_censored"), keys)
    mean = F.when(~F.col("all_censored"), F.col("ratio"))
    return joined.select(*keys, mean.alias("mean"), "all_censored",
                         F.log10(F.when(mean > 0, mean)).alias("log_mean"))
