"""Non-detect handling: flags, replicates, iterative detection-limit replacement, reports."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import count_distinct_with_null, detect, r_not_isin, ratio
from lodestat.operators.ordered import group_median, marks, running_totals, sliced
from lodestat.operators.relate import anti, attach, attach_stats, semi
from lodestat.sources.files import stored

# Streams outside the core area with only a few samples.
SPARSE_STREAMS = [
    "Issaquah Creek B",
    "Pipers Creek B",
    "Lyon Creek B",
    "North Creek C",
    "Sammamish River B",
    "Kelsey Creek C",
    "Bear Creek B",
]

REPLICATE_KEYS = ["date", "year", "month", "routine", "locator", "stream", "position",
                  "loc_group", "metal_org", "parameter", "parmname", "units"]
#: Rows of a replicate set beyond which it is combined before the shuffle.
CROWDED = 65_536
#: Rows, about, of such a set that are counted to tell it.
COUNTED = 1024
#: Rows of the other sets that are sorted in one part, about, and rows that make a further part for an idle core.
PART_ROWS, LEAST_ROWS = 1 << 17, 1 << 13


def drop_sparse_streams(df: DataFrame, streams=tuple(SPARSE_STREAMS)) -> DataFrame:
    """Remove listed streams; rows without a stream stay."""
    return df.filter(r_not_isin(F.col("stream"), streams))


def flag_censored(df: DataFrame, qual: str = "qual") -> DataFrame:
    """``below_mdl`` is true where the qualifier mentions the detection limit."""
    return df.withColumn("below_mdl",
                         F.coalesce(detect(F.col(qual), "MDL", literal=True), F.lit(False)))


def _plain_mean(column: str) -> Column:
    """Mean that returns identical inputs unchanged, so that limits can be matched exactly."""
    c = F.col(column)
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.round(F.avg(c), 12))


def _averaged(df: DataFrame, row_order, keys) -> DataFrame:
    first = F.min(F.struct(*row_order, *[c for c in ("qual", "textvalue") if c not in row_order]))
    # one struct of the keys: a constant among them would be grouped by under another name than it is sorted by, and all rows sorted twice
    return df.groupBy("_set", F.struct(*keys).alias("_keys")).agg(
        F.count(F.lit(1)).cast("string").alias("sample"),
        F.avg("value").alias("value"),
        first["qual"].alias("qual"),
        F.bool_and("below_mdl").alias("below_mdl"),
        _plain_mean("mdl").alias("mdl"),
        F.avg("rdl").alias("rdl"),
        F.avg("hardness").alias("hardness"),
        first["textvalue"].alias("textvalue")).select("_keys.*", "*").drop("_set", "_keys")


def average_replicates(df: DataFrame, row_order, keys=tuple(REPLICATE_KEYS), crowded: int = CROWDED) -> DataFrame:
    """One row per replicate set; ``sample`` becomes the replicate count (as text).

    ``row_order`` lists the columns that define the source order for the first qualifier.
    The first qualifier is text, which Spark aggregates by sorting, and most sets are too small to
    shrink before the shuffle: their rows are shuffled as they are, by a hash of the keys, and sorted
    once, hash first, in parts small enough for memory. Sets of about ``crowded`` rows or more are
    combined before the shuffle too, so that none fills a task. A count in a share of the rows tells
    these sets and the number of parts, nothing else; every row is averaged.
    """
    keys = list(keys)
    marked = df.withColumn("_set", F.xxhash64(*keys))
    share = min(1.0, COUNTED / crowded)
    sizes = stored(marked.select("_set").sample(share, 1).groupBy("_set").agg(F.count(F.lit(1)).alias("_size")))
    rows = (sizes.agg(F.sum("_size")).first()[0] or 0) / share
    spark = df.sparkSession
    # no more than the session's number, as a shuffle to over 200 parts buffers its rows and spills
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                max(1, ceil(rows / PART_ROWS), min(spark.sparkContext.defaultParallelism, ceil(rows / LEAST_ROWS))))
    large = stored(sizes.filter(F.col("_size") >= crowded * share / 2).select("_set"))
    if large.isEmpty():
        return _averaged(marked.repartition(parts, "_set"), row_order, keys)
    return _averaged(semi(marked, large, ["_set"]), row_order, keys).unionByName(
        _averaged(anti(marked, large, ["_set"]).repartition(parts, "_set"), row_order, keys))


def event_type(df: DataFrame, routine: str) -> DataFrame:
    """Metal rows of one event type with a known stream."""
    return df.filter((F.col("routine") == routine) & (F.col("metal_org") == "Metal")
                     & F.col("stream").isNotNull())


def percent_censored(df: DataFrame, keys, flag: str = "below_mdl") -> DataFrame:
    """Row count and percentage of rows below the detection limit."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        (100 * F.avg(F.col(flag).cast("double"))).alias("percent_below_mdl"))


def all_nondetect_parameters(df: DataFrame) -> DataFrame:
    return (df.groupBy("parameter").agg(F.bool_and("below_mdl").alias("_all"))
            .filter("_all").select("parameter"))


def split_all_nondetect(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of parameters with detects, rows of fully censored parameters with MDL/2)."""
    hidden = stored(all_nondetect_parameters(df))
    half = F.col("mdl") / 2
    return anti(df, hidden, ["parameter"]), semi(df, hidden, ["parameter"]).withColumns(
        {"replacement": half, "rvalue": half, "rvqual": F.lit("AllNonDetect")})


def _forty_percent(mdl: Column, below: Column, rows: Column) -> Column:
    """The limit itself when fewer than 40 % of its rows are below it, else half of it."""
    return F.when(ratio(below, rows) < 0.4, mdl).otherwise(mdl / 2)


def substitute_40pct(df: DataFrame, keys=("stream", "parameter", "mdl"),
                     qualifier: str = "LowestMDL") -> DataFrame:
    """Apply the 40 % rule alone to every (group, limit)."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("below_mdl").alias("_below"))
    few = ratio(F.col("_below"), F.col("_rows")) < 0.4
    below = F.col("below_mdl")
    joined = attach_stats(df, counts, list(keys))
    return joined.withColumns({
        "replacement": F.when(below, _forty_percent(F.col("mdl"), F.col("_below"), F.col("_rows"))),
        "rvqual": F.when(below, F.concat(F.lit(qualifier + ", "),
                                         F.when(few, "<40%").otherwise(">40%"))),
    }).withColumn("rvalue", F.when(below, F.col("replacement")).otherwise(F.col("value"))
                  ).drop("_rows", "_below")


def replacement_levels(df: DataFrame, keys=("stream",), parameter: str = "parameter") -> DataFrame:
    """Replacement value and qualifier for every (stream, parameter, limit).

    Limits of a group are processed upwards. A limit takes the mean of everything already
    settled below it: detects whose value and limit both lie below, and replaced non-detects of
    lower limits. How many values are settled below a limit depends on counts only, so it is a
    running count. The sum R of lower replacements obeys R' = a R + c with a = 1 + below/settled
    for a mean and a = 1 otherwise, so R is a running product times a running sum.
    """
    group = [*keys, parameter]
    below, value = F.col("below_mdl"), F.col("value")
    # One pass over the rows: a detect with a value matters from the first limit above both
    # its value and its own limit.
    cells = stored(df.groupBy(
        *group, "mdl", F.when(~below, F.greatest("mdl", value)).alias("_from")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(below).alias("_below"),
        F.count(F.when(~below, value)).alias("_n"), F.sum(F.when(~below, value)).alias("_sum"),
        F.max(value).alias("_top")))
    tops = cells.groupBy(*group).agg(F.max("_top").alias("_group_top"))
    lowest = cells.groupBy(parameter).agg(
        F.min("mdl").alias("_lowest"), F.sum(F.col("_rows") - F.col("_below")).alias("_detects"),
    ).filter(F.col("_detects") > 0).drop("_detects")
    named = cells.filter(F.col("mdl").isNotNull()).select(
        *group, F.explode(F.array(
            F.struct(F.col("mdl").alias("_at"), F.col("_rows"), F.col("_below"),
                     F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_sum")),
            F.struct(F.col("_from").alias("_at"), F.lit(0).cast("long").alias("_rows"),
                     F.lit(0).cast("long").alias("_below"), F.col("_n"),
                     F.coalesce("_sum", F.lit(0.0)).alias("_sum")))).alias("_e")
    ).select(*group, "_e.*").filter(F.col("_at").isNotNull())
    merged = named.groupBy(*group, "_at").agg(
        *[F.sum(c).alias(c) for c in ("_rows", "_below", "_n", "_sum")])
    events = merged.join(tops, group).join(lowest, parameter)
    is_level = F.col("_rows") > 0
    is_lowest = is_level & (F.col("_at") == F.col("_lowest"))
    is_high = is_level & ~is_lowest & F.coalesce(F.col("_at") >= F.col("_group_top"), F.lit(True))
    events = events.withColumns({
        "_is_lowest": is_lowest, "_is_high": is_high,
        "_kept": F.when(is_high, 0).otherwise(F.col("_below")),
    }).drop("_group_top", "_lowest")
    seen = running_totals(sliced(events, group, "_at"), group, "_at", ["_rows", "_kept", "_n", "_sum"], cut=False)
    settled = F.col("_kept_before") + F.col("_n_before")
    by_mean = ~F.col("_is_lowest") & ~F.col("_is_high") & (settled > 0)
    rule = _forty_percent(F.col("_at"), F.col("_below"), F.col("_rows"))
    steps = seen.filter(F.col("_rows") > 0).withColumns({
        "_settled": settled, "_by_mean": by_mean, "_rule": rule,
    }).withColumns({
        "_log_a": F.when(F.col("_by_mean"), F.ln(1 + ratio(F.col("_below"), F.col("_settled"))))
                  .otherwise(F.lit(0.0)),
        "_c": F.when(F.col("_is_high"), F.lit(0.0))
              .when(F.col("_by_mean"),
                    ratio(F.col("_below") * F.col("_sum_before"), F.col("_settled")))
              .otherwise(F.col("_below") * F.col("_rule")),
    }).select(*group, "_at", "_is_lowest", "_is_high", "_by_mean", "_rule", "_settled", "_rows",
              "_below", F.col("_rows_before").alias("_processed"),
              F.col("_sum_before").alias("_detected"), "_log_a", "_c", *marks(seen))
    grown = running_totals(steps, group, "_at", ["_log_a"], cut=False).withColumn(
        "_share", F.col("_c") * F.exp(-(F.col("_log_a_before") + F.col("_log_a"))))
    summed = running_totals(grown.drop("_log_a_all"), group, "_at", ["_share"], cut=False)
    lower = F.exp(F.col("_log_a_before")) * F.col("_share_before")
    size = F.when(ratio(F.col("_below"), F.col("_rows")) < 0.4, "<40%").otherwise(">40%")
    case = (F.when(F.col("_is_lowest"), "LowestMDL")
            .when(F.col("_processed") == 0, "NoLowerData").otherwise("LowerData>MDL"))
    return summed.select(
        *group, F.col("_at").alias("mdl"),
        F.when(F.col("_is_high"), F.lit(None))
         .when(F.col("_by_mean"), ratio(F.col("_detected") + lower, F.col("_settled")))
         .otherwise(F.col("_rule")).alias("replacement"),
        F.when(F.col("_is_high"), F.lit("HighNonDetect"))
         .when(F.col("_by_mean"), F.lit("LowerMean"))
         .otherwise(F.concat_ws(", ", case, size)).alias("rvqual"))


def replace_nondetects(df: DataFrame, keys=("stream",)) -> DataFrame:
    """Replace non-detects limit by limit within each (stream, parameter).

    Parameters without any detect are left out, as are rows without a detection limit.
    """
    group = [*keys, "parameter"]
    levels = stored(replacement_levels(df, keys))
    below = F.col("below_mdl")
    return df.join(levels, [*group, "mdl"]).withColumns({
        "replacement": F.when(below, F.col("replacement")),
        "rvalue": F.when(below, F.col("replacement")).otherwise(F.col("value")),
        "rvqual": F.when(below, F.col("rvqual")),
    })


def censored_value(df: DataFrame, name: str = "cvalue") -> DataFrame:
    """The limit for a non-detect, the value for a detect."""
    return df.withColumn(name, F.when(F.col("below_mdl"), F.col("mdl")).otherwise(F.col("value")))


def flip_values(df: DataFrame, keys) -> DataFrame:
    """Turn left-censored values into right-censored ones: group maximum + 10 minus the value."""
    top = F.greatest(F.max("value"), F.max("mdl")) + 10
    tops = df.groupBy(*keys).agg(top.alias("_flip"))
    shown = F.when(F.col("below_mdl"), F.col("mdl")).otherwise(F.col("value"))
    return attach_stats(df, tops, list(keys)).withColumns(
        {"flip_value": F.col("_flip") - shown, "event": ~F.col("below_mdl")}).drop("_flip")


def mdl_by_year(df: DataFrame) -> DataFrame:
    """Lowest, highest and median limit and number of limits by parameter and year."""
    keys = ["parameter", "year"]
    extremes = df.groupBy(*keys).agg(
        F.min("mdl").alias("lowest"), F.max("mdl").alias("highest"),
        count_distinct_with_null(F.col("mdl")).alias("count"))
    return attach(extremes, group_median(df, keys, "mdl"), keys)


def mdl_year_ranges(df: DataFrame) -> DataFrame:
    """Years in which each lowest limit applied, until a lower limit appears.

    Works on one row per (parameter, lowest limit), at most one per year.
    """
    yearly = df.groupBy("parameter", "year").agg(F.min("mdl").alias("lowest"))
    latest = yearly.groupBy("parameter").agg(F.max("year").alias("_latest"))
    first = (yearly.filter(F.col("lowest").isNotNull())
             .groupBy("parameter", "lowest").agg(F.min("year").alias("from_year")))
    lower = (Window.partitionBy("parameter").orderBy("lowest")
             .rowsBetween(Window.unboundedPreceding, -1))
    ranged = first.withColumn("_next", F.min("from_year").over(lower))
    return (attach(ranged, latest, ["parameter"])
            .withColumn("to_year", F.coalesce("_next", "_latest"))
            .filter(F.col("to_year") >= F.col("from_year"))
            .select("parameter", "lowest", "from_year", "to_year"))


def rare_detect_parameters(df: DataFrame, above: float = 66.0) -> DataFrame:
    """Parameters whose share of non-detects exceeds ``above`` percent."""
    return percent_censored(df, ["parameter"]).filter(F.col("percent_below_mdl") > above)


def rare_detects(df: DataFrame, above: float = 66.0) -> DataFrame:
    """Valued rows of parameters that are mostly below the limit."""
    return semi(df.filter(F.col("value").isNotNull()), stored(rare_detect_parameters(df, above)),
                ["parameter"])


def censoring_report(df: DataFrame) -> dict[str, DataFrame]:
    """Censoring by parameter, by parameter and limit, and by parameter, stream and limit."""
    return {"parameter": percent_censored(df, ["parameter"]),
            "parameter_mdl": percent_censored(df, ["parameter", "mdl"]),
            "stream_mdl": percent_censored(df, ["parameter", "stream", "mdl"])}


def sampling_coverage(df: DataFrame) -> DataFrame:
    """Samples, streams and median samples per stream by parameter and year."""
    counts = (df.filter(F.col("metal_org") == "Metal").groupBy("parameter", "year", "stream")
              .agg(F.count(F.lit(1)).alias("n")))
    keys = ["parameter", "year"]
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("num_samples"),
                                       F.count(F.lit(1)).alias("num_streams"))
    return attach(totals, group_median(counts, keys, "n", "n_per_stream"), keys)
