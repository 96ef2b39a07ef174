import datetime as dt
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from lodestat.operators import compare, survival
from tests.conftest import close, measured


def km_brute(points):
    """Redistribute the mass of every non-detect to what lies below it, from the top down."""
    values = sorted({v for v, _ in points})
    left, mass = 1.0, {}
    for v in reversed(values):
        at = [c for x, c in points if x == v]
        risk = sum(x <= v for x, _ in points)
        mass[v] = left * (len(at) - sum(at)) / risk
        left -= mass[v]
    mean = sum(v * m for v, m in mass.items()) + left * values[0]
    square = sum(v * v * m for v, m in mass.items()) + left * values[0] ** 2
    total, median = left, None
    for v in values:
        total += mass[v]
        if mass[v] > 0 and total >= 0.5 - 1e-9 and median is None:
            median = v
    return mean, (median if left <= 0.5 + 1e-9 else None), math.sqrt(max(square - mean ** 2, 0.0))


def test_km_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(120):
        for _ in range(rng.randint(1, 15)):
            below = rng.random() < 0.4
            v = float(rng.randint(1, 8))
            rows.append((f"s{g}", "p", v, None if below else v, below))
    rows += [("all", "p", 2.0, None, True), ("all", "p", 5.0, None, True), ("one", "p", 1.0, 3.0, False)]
    got = {r["stream"]: r for r in survival.km_summary(measured(spark, rows)).collect()}
    for g in {r[0] for r in rows}:
        points = [(r[2] if r[4] else r[3], r[4]) for r in rows if r[0] == g]
        mean, median, sd = km_brute(points)
        r = got[g]
        assert close(r["mean"], mean) and close(r["sd"], sd, 1e-6) and r["median"] == median, g
        assert (r["n"], r["n_censored"]) == (len(points), sum(c for _, c in points))
        assert r["all_censored"] == all(c for _, c in points)
    table = {r["stream"]: r for r in survival.km_table(survival.km_summary(measured(spark, rows))).collect()}
    assert table["all"]["mean"] is None and table["all"]["log_mean"] is None
    assert close(table["one"]["log_mean"], math.log10(3.0))


def test_compare_means(spark):
    km = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 2.0), ("c", "p", 0.0)],
                               "stream string, parameter string, mean double")
    means = spark.createDataFrame([("a", "p", 1.05), ("b", "p", 3.0), ("c", "p", 1.0), ("d", "p", 1.0)],
                                  "stream string, parameter string, grand_mean double")
    assert [r["stream"] for r in survival.compare_means(km, means).collect()] == ["b"]


def mixed(spark, rows):
    return spark.createDataFrame(rows, "routine string, stream string, parameter string, date date, "
                                 "mdl double, value double, below_mdl boolean, rvalue double")


def gehan_brute(rows):
    """All pairs: +1 surely below, -1 surely above."""
    obs = [(r[4] if r[6] else r[5], r[6], r[0] == "wet weather") for r in rows]
    scores = []
    for y, c, _ in obs:
        u = 0
        for z, d, _ in obs:
            if not c and not d:
                u += (z < y) - (z > y)
            elif not c and d:
                u += z <= y
            elif c and not d:
                u -= y <= z
        scores.append(u)
    w = sum(u for u, o in zip(scores, obs) if o[2])
    n1 = sum(o[2] for o in obs)
    n2, n = len(obs) - n1, len(obs)
    return w / math.sqrt(n1 * n2 * sum(u * u for u in scores) / (n * (n - 1)))


def test_gehan_against_brute_force(spark):
    rng = random.Random(6)
    day = dt.date(2002, 1, 1)
    rows = []
    for p in range(12):
        for s in range(3):
            for kind in ("wet weather", "Routine"):
                for _ in range(rng.randint(2, 6) + (kind == "Routine")):
                    below = rng.random() < 0.35
                    v = float(rng.randint(1, 9))
                    rows.append((kind, f"s{s}", f"p{p}", day, v, None if below else v, below, v / 2 if below else v))
    df = mixed(spark, rows)
    got = {r["parameter"]: r for r in compare.gehan_test(df).collect()}
    checked = 0
    for p in {r[2] for r in rows}:
        sub = []
        for s in range(3):
            both = [r for r in rows if r[2] == p and r[1] == f"s{s}"]
            if all(sum(r[0] == k for r in both) >= 3 for k in ("wet weather", "Routine")):
                sub += both
        if not sub:
            assert p not in got
            continue
        z = gehan_brute(sub)
        wet = [r for r in sub if r[0] == "wet weather"]
        assert close(got[p]["gehan_stat"], z) and close(got[p]["p"], 1 - NormalDist().cdf(z), 1e-6)
        assert close(got[p]["mean_wet"], sum(r[7] for r in wet) / len(wet))
        assert close(got[p]["censored_wet"], 100 * sum(r[6] for r in wet) / len(wet))
        checked += 1
    assert checked > 5
    by_stream = compare.gehan_test(df, ["stream", "parameter"]).collect()
    for r in by_stream[:8]:
        z = gehan_brute([x for x in rows if x[1] == r["stream"] and x[2] == r["parameter"]])
        assert close(r["gehan_stat"], z)


def test_levels_and_flags(spark):
    tests = spark.createDataFrame([("a", 3.0, 1.0, 0.001), ("b", 3.0, 1.0, 0.04), ("c", 1.0, 3.0, 0.001),
                                   ("d", 2.0, 1.0, None)],
                                  "parameter string, mean_wet double, mean_routine double, p double")
    level = compare.sidak_level(tests, F.col("mean_wet") > F.col("mean_routine"))
    row = level.first()
    assert row["tests"] == 3 and row["level"] == pytest.approx(1 - 0.95 ** (1 / 3))
    got = {r["parameter"]: (r["sig"], r["pseudosig"]) for r in compare.flag_significant(tests, level).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (False, False), "d": (None, None)}
    assert compare.sidak_level(tests.filter("p > 1"), F.lit(True)).first()["level"] == 1.0


def test_ratio_classes(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (3.0,), (7.0,), (100.0,), (None,)], "storm_base_ratio double")
    assert [r["fill"] for r in compare.ratio_classes(df).collect()] == [None, 1, 2, 3, 4, None]


def test_align_and_prune(spark):
    d = dt.date
    storm = mixed(spark, [("wet weather", "a", "p", d(2001, 3, 1), 1.0, 2.0, False, 2.0),
                          ("wet weather", "a", "p", d(1999, 1, 1), 1.0, 2.0, False, 2.0),
                          ("wet weather", "x", "p", d(2001, 5, 1), 1.0, 2.0, False, 2.0),
                          ("wet weather", "a", "r", d(2001, 5, 1), 1.0, 2.0, False, 2.0)])
    base = mixed(spark, [("Routine", "a", "p", d(2001, 3, 31), 1.0, 2.0, False, 2.0),
                         ("Routine", "b", "p", d(2001, 6, 1), 1.0, 2.0, False, 2.0),
                         ("Routine", "a", "q", d(2001, 6, 1), 1.0, 2.0, False, 2.0)])
    got = sorted((r["routine"], r["stream"], r["parameter"], r["date"].isoformat())
                 for r in compare.align_domains(storm, base).collect())
    assert got == [("Routine", "a", "p", "2001-03-31"), ("wet weather", "a", "p", "2001-03-01")]
    rows = [("Routine", "a", "p", d(2001, 1, i), 1.0, 2.0, False, 2.0) for i in (1, 2, 3)]
    rows += [("wet weather", "b", "p", d(2001, 1, i), 1.0, 2.0, False, 2.0) for i in (1, 1, 2)]
    rows += [("Routine", "a", "hidden", d(2001, 1, 1), 1.0, None, True, 0.5)]
    pruned = compare.prune_sparse(mixed(spark, rows)).collect()
    assert {(r["stream"], r["parameter"]) for r in pruned} == {("a", "p")} and len(pruned) == 3
