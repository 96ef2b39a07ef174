"""Running totals, exact quantiles and ranks that never put a large group into one task.

A group may hold a large part of all rows, so an ordinary window over it would run in one
task. A group of more than ``SLICE_ROWS`` rows is cut into slices at borders taken from a hashed
share of its own rows, in the very order asked for: value, then ties, then a number given to each
row. So slices are of nearly equal size whatever the values are: close together, equal, or text.
Running totals are windows over one slice; the sums of the slices of a group are added up in a
table of their own and joined back by measured size. The detail rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.operators.relate import attach
from lodestat.sources.files import stored

#: Rows of a slice, about, and of the largest group that is not cut.
SLICE_ROWS = 65_536
#: Rows by which a border is estimated, and rows at most that give a group's borders.
PER_BORDER, MOST_SAMPLED = 64, 1 << 20
#: The columns that keep a table's rows in slices between running totals in the same order.
MARKS = ("_row", "_slice")


def marks(df: DataFrame) -> list[str]:
    return [c for c in MARKS if c in df.columns]


def sliced(points: DataFrame, keys, value: str, ties=()) -> DataFrame:
    """``points``, stored, with a number for each row and, if any group is large, the slice of its
    rows (null for rows of other groups)."""
    points = stored(points.withColumn("_row", F.monotonically_increasing_id()))
    large = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > SLICE_ROWS)
    if large.isEmpty():
        return points
    large = stored(large)
    keys, columns = list(keys), points.columns
    if not keys:
        keys, points, large = ["_whole"], points.withColumn("_whole", F.lit(0)), large.withColumn("_whole", F.lit(0))
    place = F.struct(value, *ties, "_row")
    share = F.least(F.lit(PER_BORDER / SLICE_ROWS), MOST_SAMPLED / F.col("_size"))
    sample = attach(points, large, keys, "inner").filter(F.pmod(F.xxhash64("_row"), F.lit(1 << 30)) < share * (1 << 30)).select(*keys, place.alias("_at"))
    group = Window.partitionBy(*keys)
    borders = sample.withColumn("_i", F.row_number().over(group.orderBy("_at"))).filter(F.col("_i") % PER_BORDER == 0)
    borders = borders.withColumn("_i", F.floor(F.col("_i") / PER_BORDER) - 1)
    # borders in two steps, so that a row is compared with about twice the square root of their number
    borders = borders.withColumn("_width", F.ceil(F.sqrt(F.max("_i").over(group) + 1)))
    parts = borders.groupBy(*keys, "_width", F.floor(F.col("_i") / F.col("_width")).alias("_part")).agg(F.sort_array(F.collect_list("_at")).alias("_inner"))
    trees = stored(parts.groupBy(*keys, "_width").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_part", "_inner"))), lambda x: x["_inner"]).alias("_tree")))
    before = F.size(F.filter("_tree", lambda part: part[0] <= place))
    inside = F.when(before > 0, F.size(F.filter(F.col("_tree")[before - 1], lambda x: x <= place)) + (before - 1) * F.col("_width")).otherwise(0)
    return stored(attach(points, trees, keys).select(*columns, F.when(F.col("_tree").isNotNull(), inside).cast("long").alias("_slice")))


def running_totals(points: DataFrame, keys, value: str, totals, ties=(), cut: bool = True) -> DataFrame:
    """Add ``<t>_before`` (sum over earlier rows of the group) and ``<t>_all`` (group sum).

    ``points`` should be aggregated to one row per (keys, value, ties) beforehand, so that the
    sums are partially combined on the map side. Order is by ``value`` then ``ties``; rows equal in
    both keep any fixed order. With ``cut=False`` the points come from ``sliced`` in this order and
    keep their marks, so that further totals can follow without a new shuffle.
    """
    keys, totals = list(keys), list(totals)
    columns = list(points.columns)
    rows = sliced(points, keys, value, ties) if cut else points
    many = "_slice" in rows.columns
    in_slice = Window.partitionBy(*keys, *(["_slice"] if many else []))
    earlier = in_slice.orderBy(value, *ties, "_row").rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    if many:
        rows = rows if cut else stored(rows)
        sums = rows.filter(F.col("_slice").isNotNull()).groupBy(*keys, "_slice").agg(*[F.sum(t).alias(t) for t in totals])
        group = Window.partitionBy(*(keys or [F.lit(0)]))
        below = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = stored(sums.select(*keys, "_slice", *[F.sum(t).over(below).alias(f"_{t}_skip") for t in totals],
                                   *[F.sum(t).over(group).alias(f"_{t}_whole") for t in totals]))
        rows = attach(rows, carry, [*keys, "_slice"])
        carried = [c for t in totals for c in (f"_{t}_skip", f"_{t}_whole")]
    nothing = F.lit(0)
    skip = lambda t: F.coalesce(f"_{t}_skip", nothing) if many else nothing
    whole = lambda t: F.coalesce(F.col(f"_{t}_whole"), F.sum(t).over(in_slice)) if many else F.sum(t).over(in_slice)
    out = rows.select("*", *[(F.coalesce(F.sum(t).over(earlier), nothing) + skip(t)).alias(f"{t}_before") for t in totals],
                      *[whole(t).alias(f"{t}_all") for t in totals]).drop(*carried)
    return out if not cut else out.select(*columns, *[f"{t}_{end}" for end in ("before", "all") for t in totals])


def exact_quantiles(df: DataFrame, keys, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Interpolated (type 7) quantiles per group, missing values ignored.

    Groups without any value are absent from the result.
    """
    points = (df.select(*keys, F.col(value).cast("double").alias("_v"))
              .filter(F.col("_v").isNotNull())
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_totals(points, keys, "_v", ["_n"])
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n")

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < last), F.col("_v")))

    picks, results = [], []
    for name, p in quantiles.items():
        place = (F.col("_n_all") - 1) * F.lit(float(p))
        picks += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"),
                  F.max(place - F.floor(place)).alias(f"_part_{name}")]
        results.append((F.col(f"_lo_{name}") + F.col(f"_part_{name}")
                        * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *results)


def group_median(df: DataFrame, keys, value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def ordinal_positions(df: DataFrame, keys, value: str, ties, name: str = "position") -> DataFrame:
    """1-based position of each row in its group by ``value`` then ``ties``; with group size (both long)."""
    ranked = running_totals(df.withColumn("_one", F.lit(1).cast("long")), keys, value, ["_one"], ties)
    return (ranked.withColumn(name, F.col("_one_before") + 1)
            .withColumn("group_size", F.col("_one_all"))
            .drop("_one", "_one_before", "_one_all"))


def rank_categories(df: DataFrame, category: str, value: str, name: str = "rank") -> DataFrame:
    """Rank categories by descending total of ``value``, ties in category order."""
    totals = df.groupBy(category).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    ranked = ordinal_positions(totals.withColumn("_down", -F.col("total")), [], "_down",
                               [category], name)
    return ranked.select(category, "total", name)


def alphabetical_rank(df: DataFrame, category: str, name: str = "rank") -> DataFrame:
    """Rank of each category in sorted order: the number of categories before it plus one."""
    labels = df.select(F.col(category)).distinct().filter(F.col(category).isNotNull())
    return ordinal_positions(labels, [], category, [], name).select(category, name)


def sorted_levels(df: DataFrame, keys, column: str, name: str = "level") -> DataFrame:
    """Distinct non-missing values of a column per group, numbered upwards from 1."""
    levels = df.select(*keys, column).filter(F.col(column).isNotNull()).distinct()
    return ordinal_positions(levels, keys, column, [], name).drop("group_size")
