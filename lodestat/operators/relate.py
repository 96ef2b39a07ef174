"""Joins, sets, sorting and row binding with the source data's null rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.sources.files import stored


def _matched(left: DataFrame, right: DataFrame, keys, how: str, keep=None) -> DataFrame:
    """Join on keys where null matches null; right keys are renamed away."""
    keep = [c for c in (keep or right.columns) if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *keep)
    condition = reduce(lambda a, b: a & b,
                       [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how)


def attach(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Left or inner lookup join, null matching null; several matches multiply rows."""
    joined = _matched(left, right, keys, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def attach_stats(df: DataFrame, stats: DataFrame, keys, how: str = "left") -> DataFrame:
    """Put group statistics beside rows.

    The statistics are written first, so that their size is known when the join is planned and
    the rows are not shuffled to meet a small table.
    """
    return attach(df, stored(stats), keys, how)


def full_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Full outer join on shared keys, keys taken from whichever side has the row."""
    joined = _matched(left.withColumn("_in_left", F.lit(True)), right, keys, "full")
    merged = [F.when(F.col("_in_left"), F.col(k)).otherwise(F.col(f"_r_{k}")).alias(k)
              for k in keys]
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return joined.select(*merged, *rest)


def semi(df: DataFrame, members: DataFrame, keys) -> DataFrame:
    """Rows whose key occurs among the members, null matching null."""
    return _matched(df, members.select(*keys), keys, "left_semi", keep=keys)


def anti(df: DataFrame, members: DataFrame, keys) -> DataFrame:
    """Rows whose key does not occur among the members, null matching null."""
    return _matched(df, members.select(*keys), keys, "left_anti", keep=keys)


def enrich(raw: DataFrame, *lookups: tuple[DataFrame, list[str]]) -> DataFrame:
    """Chain of left lookup joins; a lookup with repeated keys multiplies rows."""
    return reduce(lambda df, lookup: attach(df, lookup[0], lookup[1]), lookups, raw)


def attach_covariate(df: DataFrame, covariate: DataFrame, keys=("locator", "date")) -> DataFrame:
    """Put a covariate measured at the same place and date beside each row; fan-out kept."""
    return attach(df, covariate, list(keys))


def exclude(df: DataFrame, bad: DataFrame, keys=("sample", "parameter")) -> DataFrame:
    """Remove listed (sample, parameter) rows."""
    return anti(df, bad, list(keys))


def assert_unique(lookup: DataFrame, keys) -> DataFrame:
    """Same rows, but the job fails if a key occurs twice (opt-in guard for lookups)."""
    counts = lookup.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    checked = counts.select(*keys, F.when(
        F.col("_rows") > 1, F.raise_error(F.lit("lookup key is not unique")).cast("boolean")
    ).otherwise(F.lit(True)).alias("_unique"))
    return attach(lookup, checked, list(keys)).filter("_unique").drop("_unique")


def distinct_of(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns).distinct()


def arrange(df: DataFrame, *columns) -> DataFrame:
    """Sort with missing values last; a leading '-' sorts that column downwards."""
    return df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c.startswith("-")
                        else F.col(c).asc_nulls_last() for c in columns])


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; columns absent from one side are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
