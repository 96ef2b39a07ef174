"""Local quadratic smoother from moments of blocks of neighbouring x.

No row meets every grid point. The reach of a grid point is found among runs of neighbours in the
order of x: the run that begins at a value ends where the wanted share of rows is full, and its
middle grows with its begin, so the nearest run of a grid point is one of the two runs whose middles
lie on either side of it. The tricube weight is a polynomial on each side of a grid point, so a block
of neighbouring x that lies wholly on one side and inside the reach adds its weighted sums from its
own moments. Only rows of the few blocks that hold the grid point or an end of its reach are looked
at one by one.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import ratio
from lodestat.operators.ordered import running_totals
from lodestat.operators.relate import attach
from lodestat.sources.files import stored

#: Blocks of a group, of about equally many rows.
BLOCKS = 512
#: Row positions of a part in which ends of runs are looked up, and parts of a group at most.
PART_ROWS, MOST_PARTS = 65_536, 4096
#: The tricube weight (1 - v**3)**3 as powers of v.
TRICUBE = ((0, 1.0), (3, -3.0), (6, 3.0), (9, -1.0))


def _runs(cells: DataFrame, keys, span: float) -> DataFrame:
    """First and last x of every run of neighbours that holds the wanted share of a group's rows."""
    total = F.col("_n_all")
    wanted = F.greatest(F.lit(1), F.floor(total * span + 1e-5)).cast("long")
    parts = F.least(F.lit(MOST_PARTS), F.ceil(total / PART_ROWS)).cast("long")
    cells = cells.withColumns({"_parts": parts, "_end": F.col("_n_before") + wanted - 1})
    ends = cells.filter(F.col("_end") < total).select(
        *keys, F.expr("_end * _parts div _n_all").alias("_part"), F.col("_end").alias("_at"),
        F.col("_x").alias("_first"), F.lit(None).cast("double").alias("_last"))
    part = F.explode(F.expr("sequence(_n_before * _parts div _n_all, (_n_before + _n - 1) * _parts div _n_all)"))
    covers = cells.withColumn("_part", part).select(
        *keys, "_part", F.greatest("_n_before", F.expr("(_part * _n_all + _parts - 1) div _parts")).alias("_at"),
        F.lit(None).cast("double").alias("_first"), F.col("_x").alias("_last"))
    upto = Window.partitionBy(*keys, "_part").orderBy("_at", F.col("_first").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return ends.unionByName(covers).withColumn("_last", F.last("_last", True).over(upto)).filter(
        F.col("_first").isNotNull())


def _grid(cells: DataFrame, keys, span: float, grid_points: int) -> DataFrame:
    """Grid points of every group with more than one x, and the distance each reaches."""
    bounds = cells.groupBy(*keys).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    bounds = stored(bounds.filter(F.col("_high") > F.col("_low")))
    width = (F.col("_high") - F.col("_low")) / (grid_points - 1)
    middle = (F.col("_first") + F.col("_last")) / 2
    run = F.struct("_first", "_last")
    runs = (attach(_runs(cells, keys, span), bounds, keys, "inner")
            .withColumn("_i", F.greatest(F.lit(0), F.least(F.lit(grid_points), F.ceil((middle - F.col("_low")) / width))).cast("int"))
            .groupBy(*keys, "_i").agg(F.max(run).alias("_left"), F.min(run).alias("_right")))
    points = bounds.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid_points))))
    group = Window.partitionBy(*keys).orderBy("_i")  # one row for each grid point and one more
    found = attach(points, runs, [*keys, "_i"]).withColumns({
        "_left": F.max("_left").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_right": F.min("_right").over(group.rowsBetween(1, Window.unboundedFollowing)),
        "_g": F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_i") / (grid_points - 1)})
    far = [F.greatest(F.col("_g") - F.col(f"{side}._first"), F.col(f"{side}._last") - F.col("_g"))
           for side in ("_left", "_right")]
    return found.filter(F.col("_i") < grid_points).select(*keys, "_i", "_g", F.least(*far).alias("_reach")).filter(
        F.col("_reach") > 0)


def _of_rows(points: DataFrame, keys) -> DataFrame:
    """Weighted sums from x, row count and sum of y, one by one."""
    points = points.withColumn("_u", ratio(F.col("_x") - F.col("_g"), F.col("_reach"))).filter(F.abs("_u") < 1)
    weight = F.pow(1 - F.pow(F.abs("_u"), F.lit(3.0)), F.lit(3.0))
    points = points.withColumns({"_kn": weight * F.col("_n"), "_ky": weight * F.col("_sy")})
    return points.groupBy(*keys, "_i", "_g").agg(
        *[F.sum(F.col("_kn") * F.pow("_u", F.lit(float(a)))).alias(f"_s{a}") for a in range(5)],
        *[F.sum(F.col("_ky") * F.pow("_u", F.lit(float(a)))).alias(f"_t{a}") for a in range(3)])


def _of_blocks(pairs: DataFrame, keys) -> DataFrame:
    """Weighted sums from the moments of blocks wholly on one side of a grid point."""
    side = F.when(F.col("_center") < F.col("_g"), -1.0).otherwise(1.0)
    pairs = pairs.withColumns({"_side": side, "_r": side * F.col("_half") / F.col("_reach"),
                               "_d": F.abs(F.col("_center") - F.col("_g")) / F.col("_reach")})
    pairs = pairs.withColumns({f"_d{e}": F.pow("_d", F.lit(float(e))) for e in range(14)}
                              | {f"_r{e}": F.pow("_r", F.lit(float(e))) for e in range(14)})

    def moved(moment: str, p: int):
        """Moment p of the distance from the grid point, in reaches."""
        return F.expr(" + ".join(f"{comb(p, k)}D * _d{p - k} * _r{k} * {moment}{k}" for k in range(p + 1)))

    pairs = pairs.withColumns({f"_a{p}": moved("_m", p) for p in range(14)} | {f"_b{p}": moved("_y", p) for p in range(12)})

    def weighted(moment: str, a: int):
        value = " + ".join(f"({c}D) * {moment}{a + e}" for e, c in TRICUBE)
        return F.expr(f"sum({'_side * ' if a % 2 else ''}({value}))")

    return pairs.groupBy(*keys, "_i", "_g").agg(
        *[weighted("_a", a).alias(f"_s{a}") for a in range(5)], *[weighted("_b", a).alias(f"_t{a}") for a in range(3)])


def local_smooth(df: DataFrame, x: str, y: str, keys, span: float = 0.75, grid_points: int = 80) -> DataFrame:
    """Local quadratic smoother with tricube weights, evaluated on an even grid per group.

    Every grid point uses the nearest ``span`` share of the rows (one row at least). Rows with a null
    x or y don't count. A group with a single x gives no points; a point whose fit is singular has a
    null y. Work besides that on distinct x grows with the groups' blocks and grid points only.
    """
    keys = list(keys)
    cells = (df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
             .filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
             .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_sy")))
    cells = running_totals(cells, keys, "_x", ["_n"]).select(*keys, "_x", "_n", "_sy", "_n_before", "_n_all")
    cells = stored(cells.withColumn("_block", F.expr(f"_n_before * {BLOCKS} div _n_all")))
    grid = stored(_grid(cells, keys, span, grid_points))
    ends = cells.groupBy(*keys, "_block").agg(F.min("_x").alias("_from"), F.max("_x").alias("_to"))
    ends = stored(ends.withColumns({"_half": (F.col("_to") - F.col("_from")) / 2,
                                    "_center": F.col("_from") + (F.col("_to") - F.col("_from")) / 2}))
    z = F.when(F.col("_half") > 0, (F.col("_x") - F.col("_center")) / F.col("_half")).otherwise(0.0)
    blocks = stored(attach(cells, ends, [*keys, "_block"]).withColumn("_z", z)
                    .groupBy(*keys, "_block", "_from", "_to", "_half", "_center")
                    .agg(*[F.sum(F.col("_n") * F.pow("_z", F.lit(float(k)))).alias(f"_m{k}") for k in range(14)],
                         *[F.sum(F.col("_sy") * F.pow("_z", F.lit(float(k)))).alias(f"_y{k}") for k in range(12)]))
    # at most BLOCKS blocks of a group meet its grid points, however many rows it has
    pairs = attach(grid, blocks, keys, "inner").filter(
        (F.col("_g") - F.col("_to") < F.col("_reach")) & (F.col("_from") - F.col("_g") < F.col("_reach")))
    single = F.col("_half") == 0
    whole = ((F.col("_to") <= F.col("_g")) & (F.col("_g") - F.col("_from") <= F.col("_reach"))) | (
        (F.col("_from") >= F.col("_g")) & (F.col("_to") - F.col("_g") <= F.col("_reach")))
    one = [*keys, "_i", "_g", "_reach"]
    alone = pairs.filter(single).select(*one, F.col("_from").alias("_x"), F.col("_m0").alias("_n"), F.col("_y0").alias("_sy"))
    cut = pairs.filter(~single & ~whole).select(*one, "_block")
    rows = attach(cut, cells.select(*keys, "_block", "_x", "_n", "_sy"), [*keys, "_block"], "inner")
    looked = _of_rows(alone.unionByName(rows.select(*one, "_x", F.col("_n").cast("double"), "_sy")), keys)
    sums = looked.unionByName(_of_blocks(pairs.filter(~single & whole), keys)).groupBy(*keys, "_i", "_g").agg(
        *[F.sum(c).alias(c) for c in ("_s0", "_s1", "_s2", "_s3", "_s4", "_t0", "_t1", "_t2")])
    s, t = [F.col(f"_s{a}") for a in range(5)], [F.col(f"_t{a}") for a in range(3)]
    # First unknown of the symmetric 3x3 normal equations by Cramer's rule.
    c0, c1, c2 = s[2] * s[4] - s[3] * s[3], s[1] * s[4] - s[2] * s[3], s[1] * s[3] - s[2] * s[2]
    determinant = s[0] * c0 - s[1] * c1 + s[2] * c2
    solvable = F.abs(determinant) > 1e-12 * F.pow("_s0", F.lit(3.0))
    return sums.select(*keys, F.col("_g").alias("x"),
                       F.when(solvable, ratio(t[0] * c0 - t[1] * c1 + t[2] * c2, determinant)).alias("y"))
