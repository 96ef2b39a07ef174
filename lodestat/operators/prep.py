"""From raw exports to canonical measurements: lookups, hardness, fraction audit, exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import case_chain, detect, first_word, paste, r_isin, ratio
from lodestat.operators.relate import attach, bind_rows, distinct_of, full_join
from lodestat.sources.files import stored
from lodestat.sources.schema import CANONICAL_NAMES

# Fixed values: (sample, parameter) rows known to be bad.
BAD_ROWS = [
    ("L47748-4", "Nickel, Dissolved"),
    ("L44956-10", "Copper, Dissolved"),
    ("L47748-8", "Zinc, Total"),
    ("L20769-2", "Zinc, Dissolved"),
    ("L19079-6", "Magnesium, Dissolved"),
    ("L15085-12", "Copper, Dissolved"),
    ("L19079-8", "Magnesium, Dissolved"),
    ("L19079-6", "Calcium, Dissolved"),
    ("L20695-2", "Mercury, Dissolved"),
    ("L19079-8", "Calcium, Dissolved"),
]

# Factors from calcium and magnesium (ug/L) to hardness as CaCO3 (mg/L).
CALCIUM_FACTOR, MAGNESIUM_FACTOR = 2.497, 4.118


def bad_rows(spark: SparkSession) -> DataFrame:
    return stored(spark.createDataFrame(BAD_ROWS, "sample string, parameter string"))


def to_canonical(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Select and rename to the canonical layout; columns the input lacks are left out."""
    names = names or CANONICAL_NAMES
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()
                       if old in df.columns])


def disambiguate_streams(locations: DataFrame, stream: str = "STREAM",
                         group: str = "Reporting Group") -> DataFrame:
    """Append ' B' or ' C' to streams of the first or second 'Other' reporting group."""
    g, s = F.col(f"`{group}`"), F.col(f"`{stream}`")
    return locations.withColumn(stream, case_chain(
        [(F.lit(True), s),
         (detect(g, "Other 1|OTHER 1"), paste(s, F.lit(" B"))),
         (detect(g, "Other 2|OTHER 2"), paste(s, F.lit(" C")))]).cast("string"))


def location_lookup(final: DataFrame) -> DataFrame:
    """Distinct locations with disambiguated stream names."""
    return disambiguate_streams(
        distinct_of(final, "LOCATOR", "STREAM", "`POSITION ON STREAM`", "`Reporting Group`"))


def parameter_lookup(final: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Distinct parameter classes, plus classes listed in an extra table."""
    known = distinct_of(final, "PARMNAME", "`GROUP 1`", "`GROUP 2`")
    return bind_rows(extra, known) if extra is not None else known


def date_lookup(final: DataFrame, date: Column) -> DataFrame:
    """Distinct (date, sample type) pairs."""
    return final.select(date.alias("Date"),
                        F.col("`SAMPLE TYPE (ROUTINE/STORM)`").alias("Routine")).distinct()


def _cell(condition: Column, value: Column, on_duplicate: str) -> Column:
    """One cell of a long-to-wide step, with a guard against several rows per cell."""
    held = F.when(condition, value)
    if on_duplicate == "mean":
        return F.avg(held)
    return F.when(F.count(F.when(condition, F.lit(1))) > 1,
                  F.raise_error(F.lit("more than one row for a cell")).cast("double")
                  ).otherwise(F.max(held))


def derive_hardness(df: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """Add ``hardness``: from total calcium and magnesium, else the laboratory's own value.

    Laboratory hardness values of a sample fan out, as a lookup without a unique key does.
    """
    ions = ["Calcium, Total", "Magnesium, Total", "Calcium, Dissolved", "Magnesium, Dissolved"]
    p, v = F.col("parameter"), F.col("value")
    wide = df.filter(r_isin(p, ions)).groupBy("sample", "date").agg(
        _cell(p == ions[0], v, on_duplicate).alias("_ca"),
        _cell(p == ions[1], v, on_duplicate).alias("_mg")
    ).select("sample", ((F.col("_ca") * CALCIUM_FACTOR + F.col("_mg") * MAGNESIUM_FACTOR)
                        / 1000).alias("_derived"))
    lab = df.filter(detect(F.col("parmname"), "Hardness", literal=True)).select(
        "sample", F.col("value").alias("_lab"))
    hardness = full_join(wide, lab, ["sample"]).select(
        "sample", F.coalesce("_derived", "_lab").alias("hardness"))
    return attach(df.drop("hardness"), hardness, ["sample"])


def pair_fractions(df: DataFrame, keys, carried) -> DataFrame:
    """Dissolved and total rows of the same metal side by side (suffixes _d and _t)."""
    def fraction(name: str, suffix: str) -> DataFrame:
        rows = df.filter(detect(F.col("parameter"), name, literal=True))
        return rows.select(*keys, first_word(F.col("parameter")).alias("metal"),
                           *[F.col(c).alias(c + suffix) for c in carried])
    return attach(fraction("Dissolved", "_d"), fraction("Total", "_t"), [*keys, "metal"], "inner")


def audit_dissolved_over_total(df: DataFrame) -> DataFrame:
    """Samples whose dissolved result exceeds the total, with a both-below-RDL flag."""
    rows = df.filter((F.col("metal_org") == "Metal") & F.col("value").isNotNull())
    pairs = pair_fractions(rows, ["date", "locator", "stream", "sample"],
                           ["value", "qual", "textvalue"])
    below = (detect(F.col("qual_d"), "<RDL", literal=True)
             & detect(F.col("qual_t"), "<RDL", literal=True))
    return (pairs.withColumn("pct_dissolved", ratio(F.col("value_d"), F.col("value_t")) * 100)
            .filter(F.col("pct_dissolved") > 100)
            .select("metal", "stream", "locator", "date", "sample",
                    F.col("value_d").alias("dissolved"), F.col("value_t").alias("total"),
                    "pct_dissolved", "qual_d", "textvalue_d", "qual_t", "textvalue_t",
                    F.coalesce(below, F.lit(False)).alias("both_below_rdl")))
