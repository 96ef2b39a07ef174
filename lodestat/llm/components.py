"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.sources.files import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` of every id that occurs in columns a and b of ``links``.

    Each round every node moves to the neighbour, or itself, whose hash is smallest; links are then
    drawn between the places moved to. Hashed order makes chains shrink by a constant share, so the
    rounds grow with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        moved = stored(edges.groupBy("a").agg(F.min(rank("b")).alias("m"))
                       .select("a", F.least(F.col("m"), rank("a")).getField("v").alias("to")))
        labels = stored(moved.select(F.col("a").alias("node"), F.col("to").alias("label")) if labels is None else
                        labels.join(moved.select(F.col("a").alias("label"), "to"), "label", "left")
                        .select("node", F.coalesce("to", "label").alias("label")))
        edges = stored(edges.join(moved, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
                       .join(moved, "a").select(F.col("x").alias("a"), F.col("to").alias("b")).where("a <> b").distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
