"""Gapless positions of rows in groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.operators.relate import attach
from lodestat.sources.files import stored


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in the group from 0 up, and ``n``, the size of the group.

    Order is by ``order``, null first, text by its UTF-8 bytes; rows equal in it keep any fixed order
    among themselves. The rows are sorted by ranges, so a group may span tasks; one row per group and
    task links the ranges. Columns ``_tie``, ``_at``, ``_first`` and ``_part`` must not occur.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (*group, *order, "_tie")]
    fixed = stored(rows.withColumn("_tie", F.monotonically_increasing_id()))
    ranged = stored(fixed.repartitionByRange(parts, *by).sortWithinPartitions(*by)
                    .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).drop("_tie"))
    runs = ranged.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select(*group, "_part", (earlier - F.col("_first")).alias("_first"), F.sum("_rows").over(whole).alias("n")))
    return attach(ranged, runs, [*group, "_part"], "inner").withColumn("pos", F.col("_at") + F.col("_first")).drop("_at", "_first", "_part")
