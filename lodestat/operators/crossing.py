"""Where the Kendall sign sum of residuals changes sign, for groups of any size, by one plan.

The sign sum S(b) falls in steps at the slopes of pairs of points. The two steps wanted are those at
which it stops being positive and becomes negative. A bracket around each is narrowed by counting S at
trial slopes exactly, over all points; the crossings inside a bracket are listed, and the step is
selected among them by running sums. A bracket with more than ``LIST_PAIRS`` candidate pairs lists those
of a hashed share of the points instead, which only serves to place the next trials. Groups with few
points begin and end with a complete list.

A list is a join of points by bands of residual: two points that cross inside (lo, hi] lie closer at lo
than the width of the bracket times the range of x. Counting splits pairs by the highest bit in which
the ranks of their x differ, so it needs running counts only and forms no pairs. Both compare the same
computed residuals, so that list and counts agree to the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import ratio
from lodestat.operators.ordered import ordinal_positions, running_totals
from lodestat.operators.relate import anti, attach, attach_stats, semi
from lodestat.sources.files import stored

#: Pairs listed for one bracket of one group.
LIST_PAIRS = 1 << 18
#: Half distance of the two trials around a slope, relative to the slope and to the group's unit. A
#: bracket as narrow as that holds, to working precision, one slope, however many pairs have it.
NEAR, NEAR_UNIT = 1e-12, 1e-15
#: Shares of the list to either side of the step at which trials are placed.
ASIDE = (0.02, 0.1)
#: Coarse codes of slopes per factor of e.
CODES = 128
GOALS = {"pos": lambda s: s > 0, "neg": lambda s: s >= 0}


def _ends(points: DataFrame, keys) -> DataFrame:
    """One row per group: S and the number of steps left (by points) below and above all slopes, and its unit."""
    held = ~F.col("_c")
    levels = points.groupBy(*keys, "_x").agg(
        F.sum("_w").alias("_any"), F.sum(F.when(held, F.col("_w")).otherwise(0)).alias("_det"),
        F.count(F.lit(1)).alias("_any_u"), F.count_if(held).alias("_det_u"), F.min("_y").alias("_y_low"), F.max("_y").alias("_y_high"))
    seen = running_totals(levels, keys, "_x", ["_any", "_det", "_any_u", "_det_u"])
    times = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b))
    unit = ratio(F.max("_y_high") - F.min("_y_low"), F.max("_x") - F.min("_x"))
    return seen.groupBy(*keys).agg(
        times("_det", "_any_before").alias("_s_first"), (-times("_any", "_det_before")).alias("_s_last"),
        times("_det_u", "_any_u_before").alias("_c_first"), (-times("_any_u", "_det_u_before")).alias("_c_last"),
        F.sum("_any_u").alias("_points"), (F.max("_x") - F.min("_x")).alias("_x_range"),
        F.coalesce(F.nullif(unit, F.lit(0.0)), F.lit(1.0)).alias("_unit"))


def _sampled(points: DataFrame, brackets: DataFrame, keys) -> DataFrame:
    """Points beside the brackets of their group, with residuals at both ends and the band."""
    rows = attach(points, brackets, keys, "inner").withColumns({
        "_u": F.col("_y") - F.col("_lo") * F.col("_x"), "_v": F.col("_y") - F.col("_hi") * F.col("_x")})
    return rows.withColumn("_band", F.coalesce(F.floor(ratio(F.col("_u"), F.col("_width"))), F.lit(0)))


def _candidates(points: DataFrame, brackets: DataFrame, keys) -> DataFrame:
    """Pairs in the same or neighbouring bands, for each bracket."""
    bands = _sampled(points, brackets, keys).groupBy("_id", "_band").agg(F.count(F.lit(1)).alias("_n"))
    both = bands.select("_id", F.explode(F.array(F.struct("_band", F.col("_n").alias("_own"), F.lit(0).alias("_next")),
                                                 F.struct((F.col("_band") - 1).alias("_band"), F.lit(0).alias("_own"), F.col("_n").alias("_next")))).alias("_x"))
    both = both.select("_id", "_x.*").groupBy("_id", "_band").agg(F.sum("_own").cast("double").alias("_own"), F.sum("_next").alias("_next"))
    return both.groupBy("_id").agg(F.sum(F.col("_own") * (F.col("_own") + F.col("_next"))).alias("_pairs"))


def _crossings(points: DataFrame, brackets: DataFrame, keys, salt: int) -> DataFrame:
    """_id, _slope, _drop and _zero of pairs that cross inside their bracket, among a share of the points."""
    share = F.pmod(F.xxhash64("_x", "_y", "_c", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = _sampled(points, brackets, keys).filter(share < F.col("_rate"))
    rows = rows.withColumns({"_d": (~F.col("_c")).cast("double"), "_w": F.col("_w").cast("double")})
    sides = ["_x", "_y", "_d", "_w", "_u", "_v"]
    low = rows.select("_id", "_lo", "_hi", F.explode(F.when(F.col("_width").isNull(), F.array("_band")).otherwise(
        F.array("_band", F.col("_band") + 1))).alias("_band"), *[F.col(c).alias(f"{c}l") for c in sides])
    high = rows.select("_id", "_band", *[F.col(c).alias(f"{c}h") for c in sides])
    # a list costs time, not bytes of input, so bands are dealt to a declared number of tasks
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = low.repartition(tasks, "_id", "_band").join(high.repartition(tasks, "_id", "_band"), ["_id", "_band"]).filter(F.col("_xl") < F.col("_xh"))
    # What a pair adds to S is the sign of the change of its residual, bounded by 0 where the lower or the
    # upper end is unknown, up to a constant; 0 counts as a rise or fall away from a non-detect.
    bounded = lambda sign: F.greatest(-F.col("_dh"), F.least(F.col("_dl"), sign))
    at_low = F.coalesce(F.signum(F.col("_uh") - F.col("_ul")), F.lit(1.0))
    at_high = F.coalesce(F.signum(F.col("_vh") - F.col("_vl")), F.lit(-1.0))
    rise, weight = F.col("_yh") - F.col("_yl"), F.col("_wl") * F.col("_wh")
    return pairs.select("_id", F.greatest("_lo", F.least("_hi", ratio(rise, F.col("_xh") - F.col("_xl")))).alias("_slope"),
                        (weight * (bounded(at_low) - bounded(at_high))).alias("_drop"),
                        (weight * (bounded(F.signum(rise)) + F.col("_dh") - F.col("_dl"))).alias("_zero")).filter(F.col("_drop") > 0)


def _code(slope: Column) -> Column:
    """Coarse integer that never decreases while ``slope`` grows, ``CODES`` per factor of e."""
    size = F.floor((F.ln(F.abs(slope)) + 746) * CODES) + 1
    return F.when(slope > 0, size).when(slope < 0, -size).otherwise(F.lit(0)).cast("long")


def _picked(listed: DataFrame, brackets: DataFrame) -> DataFrame:
    """For each bracket: the steps of both goals in the list, slopes around them for a sampled list, and S(0) of the list.

    The list is summed by coarse codes first, in the tasks that make it; only slopes with the code of a
    step are sorted, so the list itself is not shuffled.
    """
    ends = brackets.select("_id", "_s_lo", "_s_hi")
    listed = listed.withColumn("_code", _code(F.col("_slope")))
    by_code = Window.partitionBy("_id").orderBy("_code")
    coarse = listed.groupBy("_id", "_code").agg(F.sum("_drop").alias("_drop"), F.sum("_zero").alias("_zero"),
                                                F.min("_slope").alias("_least"), F.max("_slope").alias("_most"))
    coarse = coarse.withColumns({"_cum": F.sum("_drop").over(by_code), "_all": F.sum("_drop").over(Window.partitionBy("_id"))}).join(ends, "_id")
    part = ratio(F.col("_s_lo"), F.col("_s_lo") - F.col("_s_hi"))
    coarse = stored(coarse.withColumns({"_before": F.col("_cum") - F.col("_drop"), "_target": part * F.col("_all"), "_part": part}))
    s, low, high, target = F.col("_s_lo"), F.col("_before"), F.col("_cum"), F.col("_target")
    wanted = stored(coarse.filter(((low <= s) & (s <= high)) | ((low <= target) & (target <= high))).select("_id", "_code", "_before", "_s_lo", "_target"))
    fine = listed.join(wanted, ["_id", "_code"]).select(
        "_id", "_slope", "_s_lo", "_target", (F.col("_before") + F.sum("_drop").over(Window.partitionBy("_id", "_code").orderBy("_slope"))).alias("_cum"))
    first = lambda passed: F.min(F.when(passed, F.col("_slope")))
    steps = fine.groupBy("_id").agg(first(high >= s).alias("_exact_pos"), first(high > s).alias("_exact_neg"), first(high >= target).alias("_mid"))
    aside = lambda d, c: F.min(F.when(high >= F.least(F.col("_part") + d, F.lit(1.0)) * F.col("_all"), F.col(c)))
    around = coarse.groupBy("_id").agg(F.sum("_zero").alias("_zero"), F.array(*[aside(-d, "_least") for d in ASIDE]).alias("_below"),
                                       F.array(*[aside(d, "_most") for d in ASIDE]).alias("_above"))
    return around.join(steps, "_id", "left")


def _trials(picked: DataFrame, keys, step: int) -> DataFrame:
    """Trial slopes strictly inside the brackets: two around the estimated step, some aside, and the middle."""
    lo, hi, unit = F.col("_lo"), F.col("_hi"), F.col("_unit")
    away = lambda c: F.greatest(F.abs(c) * NEAR, unit * NEAR_UNIT)
    # an end that is still open is moved out further every round
    first, last = F.coalesce(F.col("_below")[len(ASIDE) - 1], hi, F.lit(0.0)), F.coalesce(F.col("_above")[len(ASIDE) - 1], lo, F.lit(0.0))
    reach = unit * F.lit(float(16 ** min(step, 200)))
    middle = (F.when(lo.isNull() & hi.isNull(), F.array(first - reach, last + reach)).when(lo.isNull(), F.array(hi - reach))
              .when(hi.isNull(), F.array(lo + reach)).otherwise(F.array(lo + (hi - lo) / 2)))
    mid = F.col("_mid")
    tried = F.concat(F.array(mid - away(mid), mid + away(mid)), middle,
                     F.transform("_below", lambda c: c - away(c)), F.transform("_above", lambda c: c + away(c)))
    return (picked.select(*keys, "_lo", "_hi", F.explode(tried).alias("_b"))
            .filter(F.col("_b").isNotNull() & (lo.isNull() | (F.col("_b") > lo)) & (hi.isNull() | (F.col("_b") < hi)))
            .select(*keys, "_b").distinct())


def _nodes(points: DataFrame, keys) -> DataFrame:
    """Points repeated for every bit of their x rank: two points of different x share a node on opposite
    sides at one bit only, the highest one in which their ranks differ."""
    levels = ordinal_positions(points.select(*keys, "_x").distinct(), keys, "_x", [], "_rank")
    ranked = attach_stats(points, levels, [*keys, "_x"]).withColumn("_rank", F.col("_rank") - 1)
    bits = F.greatest(F.length(F.bin(F.col("group_size") - 1)), F.lit(1))
    return ranked.withColumn("_bit", F.explode(F.sequence(F.lit(0), bits - 1))).selectExpr(
        *[f"`{k}`" for k in keys], "_x", "_y", "_c", "_w", "_bit",
        "shiftright(_rank, _bit + 1) AS _prefix", "shiftright(_rank, _bit) & 1 AS _upper")


def _sign_sums(nodes: DataFrame, trials: DataFrame, keys) -> DataFrame:
    """S of every (group, trial slope), ``_s`` by weights and ``_c`` by points, from running counts per node."""
    run = [*keys, "_b", "_bit", "_prefix"]
    low, held = F.col("_upper") == 0, ~F.col("_c")
    sides = {"ld": low & held, "lc": low & ~held, "hd": ~low & held, "hc": ~low & ~held}
    residuals = attach(nodes, trials, keys, "inner").withColumn("_r", F.col("_y") - F.col("_b") * F.col("_x"))
    points = residuals.groupBy(*run, "_r").agg(
        *[F.sum(F.when(side, F.col("_w")).otherwise(F.lit(0))).alias(f"_{n}") for n, side in sides.items()],
        *[F.count_if(side).alias(f"_{n}u") for n, side in sides.items()])
    points = points.withColumns({f"_{side}{u}": F.col(f"_{side[0]}d{u}") + F.col(f"_{side[0]}c{u}") for side in ("low", "high") for u in ("", "u")})
    seen = running_totals(points, run, "_r", ["_low", "_high", "_lowu", "_highu"])

    def total(u: str) -> Column:
        # a non-detect counts as below a detect of equal residual
        up = F.col(f"_hd{u}") * (F.col(f"_low{u}_before") + F.col(f"_lc{u}")).cast("double")
        down = F.col(f"_ld{u}") * (F.col(f"_high{u}_before") + F.col(f"_hc{u}")).cast("double")
        return F.sum(up - down)

    return seen.groupBy(*keys, "_b").agg(total("").alias("_s"), total("u").alias("_c"))


def _state(groups: DataFrame, evaluated: DataFrame | None, keys) -> DataFrame:
    """Bracket of each goal: largest trial before the step and smallest one after it, with S there."""
    ends = ["_s_first", "_s_last", "_c_first", "_c_last"]
    if evaluated is None:
        known = [F.lit(None).cast("double").alias(c) for c in ("_lo", "_hi")] + [
            F.col(a).alias(b) for a, b in zip(ends, ("_s_lo", "_s_hi", "_c_lo", "_c_hi"), strict=True)]
        return groups.withColumn("_goal", F.explode(F.array(*map(F.lit, GOALS)))).select(*groups.columns, "_goal", *known)
    tried = attach(groups, evaluated, keys).withColumn("_goal", F.explode(F.array(*map(F.lit, GOALS))))
    s, b, c = F.col("_s"), F.col("_b"), F.col("_c")
    stays = F.when(F.col("_goal") == "pos", GOALS["pos"](s)).otherwise(GOALS["neg"](s))
    low, high = F.when(stays, b), F.when(~stays, b)
    return tried.groupBy(*groups.columns, "_goal").agg(
        F.max(low).alias("_lo"), F.min(high).alias("_hi"),
        F.coalesce(F.max_by(s, low), F.col("_s_first")).alias("_s_lo"), F.coalesce(F.min_by(s, high), F.col("_s_last")).alias("_s_hi"),
        F.coalesce(F.max_by(c, low), F.col("_c_first")).alias("_c_lo"), F.coalesce(F.min_by(c, high), F.col("_c_last")).alias("_c_hi"))


def zero_crossing(points: DataFrame, keys, list_pairs: int = LIST_PAIRS) -> DataFrame:
    """keys, ``slope`` (middle of the two steps, null where S doesn't change sign) and ``s_zero`` = S(0).

    ``points`` (keys, _x, _y, _c for non-detects, _w), distinct and stored. Every round narrows all open
    brackets at least by half, most by a constant share of their crossings, so the rounds end by
    themselves: with a complete list, or with a bracket no wider than working precision.
    """
    keys = list(keys)
    groups = stored(_ends(points, keys))
    changes = (F.col("_s_first") > 0) & (F.col("_s_last") < 0)
    few = F.col("_points") * F.col("_points") <= 2.0 * list_pairs
    state = _state(groups, None, keys).withColumn("_pairs", F.col("_points").cast("double") * F.col("_points") / 2)
    found, evaluated, nodes, zero = [], None, None, None
    step = 0
    while True:
        # goals with the same bracket share one list
        named = state.withColumn("_id", F.xxhash64(*keys, "_lo", "_hi"))
        rated = named.withColumn("_rate", F.sqrt(F.least(F.lit(1.0), list_pairs / F.greatest("_pairs", F.lit(1.0)))))
        if evaluated is None:
            rated = rated.withColumn("_width", F.lit(None).cast("double"))
        brackets = stored(rated.select(*keys, "_id", "_lo", "_hi", "_width", "_rate", "_s_lo", "_s_hi").dropDuplicates(["_id", *keys]))
        listed = _crossings(points, brackets.drop("_s_lo", "_s_hi"), keys, step)
        picked = stored(rated.join(_picked(listed, brackets), "_id", "left")
                        .withColumns({"_exact": F.when(F.col("_goal") == "pos", F.col("_exact_pos")).otherwise(F.col("_exact_neg"))}
                                     | {c: F.coalesce(c, F.array(*[F.lit(None).cast("double") for _ in ASIDE])) for c in ("_below", "_above")}))
        if evaluated is None:
            zero = picked.filter(few & (F.col("_goal") == "pos")).select(*keys, F.coalesce("_zero", F.lit(0.0)).alias("s_zero"))
        thin = F.col("_hi") - F.col("_lo") <= 2.5 * F.greatest(
            F.greatest(F.abs("_lo"), F.abs("_hi")) * NEAR, F.col("_unit") * NEAR_UNIT)
        complete = F.col("_rate") >= 1
        ended = complete | F.coalesce(thin, F.lit(False))
        value = F.when(complete, F.col("_exact")).otherwise(F.coalesce("_mid", F.col("_lo") + (F.col("_hi") - F.col("_lo")) / 2))
        found.append(picked.filter(changes & ended).select(*keys, "_goal", value.alias("_at")))
        trials = _trials(picked.filter(changes & ~ended), keys, step)
        if evaluated is None:
            trials = trials.union(groups.filter(~few).select(*keys, F.lit(0.0).alias("_b"))).distinct()
        trials = stored(trials)
        if trials.isEmpty():
            break
        if nodes is None:
            nodes = stored(_nodes(semi(points, groups.filter(~few).select(*keys), keys), keys))
        more = _sign_sums(nodes, trials, keys)
        evaluated = stored(more if evaluated is None else evaluated.unionByName(more))
        if step == 0:
            zero = zero.unionByName(evaluated.filter("_b = 0").select(*keys, F.col("_s").alias("s_zero")))
        waiting = groups.filter(changes & ~few)
        state = _state(waiting, evaluated, keys)
        for done in found:
            state = anti(state, done.select(*keys, "_goal"), [*keys, "_goal"])
        state = stored(state.withColumn("_id", F.xxhash64(*keys, "_lo", "_hi")).withColumn("_width", F.greatest(
            (F.col("_hi") - F.col("_lo")) * F.col("_x_range") * 1.001, F.greatest(F.abs("_lo"), F.abs("_hi")) * F.col("_x_range") * 1e-14)))
        bounds = stored(state.select(*keys, "_id", "_lo", "_hi", "_width").dropDuplicates(["_id", *keys]))
        state = state.join(stored(_candidates(points, bounds, keys)), "_id", "left").drop("_id")
        step += 1
    empty = F.lit(None).cast("double")
    facts = groups.select(*keys, empty.alias("_at"), empty.alias("s_zero")).unionByName(zero.select(*keys, empty.alias("_at"), "s_zero"))
    for more in found:
        facts = facts.unionByName(more.select(*keys, "_at", empty.alias("s_zero")))
    return facts.groupBy(*keys).agg(F.when(F.count("_at") == len(GOALS), F.sum("_at") / len(GOALS)).alias("slope"), F.max("s_zero").alias("s_zero"))
