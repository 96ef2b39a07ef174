"""Intermediate tables shared by the registered queries.

The source analyses hand over through files; so do these. Each table is written once per session
and data folder below the shared folder and read from there afterwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators import censor, compare, criteria, fractions, trend
from lodestat.operators.relate import attach_covariate
from lodestat.sources import files, testbed

_written: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{files.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _written:
        try:
            return spark.read.parquet(_written[key])
        except AnalysisException:
            del _written[key]
    path = scratch(spark, sf_dir, name)
    build().write.parquet(path)
    _written[key] = path
    return spark.read.parquet(path)


def fresh_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return censor.average_replicates(censor.flag_censored(testbed.measurements(spark, sf_dir)),
                                     ["sample", "textvalue", "hardness", "qual"])


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "replicates", lambda: fresh_replicates(spark, sf_dir))


def pooled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements whose sample is the stream and day of collection, so parameters meet."""
    df = testbed.measurements(spark, sf_dir)
    return df.withColumns({"sample": F.concat("stream", F.lit("/"), "month"),
                           "locator": F.col("position")})


def storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "storm", lambda: censor.replace_nondetects(
        censor.event_type(replicates(spark, sf_dir), compare.STORM)))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "base", lambda: censor.replace_nondetects(
        censor.event_type(replicates(spark, sf_dir), compare.BASE)))


def judged(spark: SparkSession, sf_dir: str, rows=None) -> DataFrame:
    return criteria.exceedance_ratios(criteria.attach_criteria(
        storm(spark, sf_dir), criteria.criteria_table(spark, rows)))


#: What the comparison of event types reads of a replaced row.
COMPARED = ["stream", "parameter", "routine", "date", "value", "below_mdl", "mdl", "rvalue"]


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "compared", lambda: compare.prune_sparse(compare.align_domains(
        storm(spark, sf_dir).select(*COMPARED), base(spark, sf_dir).select(*COMPARED))))


def gehan_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = files.stored(compare.gehan_test(compared(spark, sf_dir)))
    level = compare.sidak_level(tests, F.col("mean_wet") > F.col("mean_routine"))
    return compare.flag_significant(tests, level)


def yearly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "yearly_trend",
                  lambda: trend.censored_trend(storm(spark, sf_dir)))


def with_oxygen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_covariate(storm(spark, sf_dir), testbed.oxygen(spark, sf_dir))


def oxygen_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_oxygen(spark, sf_dir).filter(
        F.col("do").isNotNull() & F.col("parameter").contains("Dissolved"))
    return staged(spark, sf_dir, "oxygen_trend", lambda: trend.censored_trend(
        trend.eligible(rows, ["parameter", "stream"], "do", distinct=False), "do"))


def oxygen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fractions.oxygen_partition(
        fractions.partition_fractions(storm(spark, sf_dir)), testbed.oxygen(spark, sf_dir))
