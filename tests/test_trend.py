import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import smooth, trend
from tests.conftest import close
from tests.test_survival_compare import km_brute


def sign_sum(b, rows):
    total = 0
    for i in range(len(rows)):
        for j in range(len(rows)):
            (xi, yi, ci), (xj, yj, cj) = rows[i], rows[j]
            if xi >= xj or (ci and cj):
                continue
            ri, rj = yi - b * xi, yj - b * xj
            if not ci and not cj:
                total += (rj > ri) - (rj < ri)
            elif ci:
                total += rj >= ri
            else:
                total -= ri >= rj
    return total


def slope_brute(rows):
    breaks = sorted({(b[1] - a[1]) / (b[0] - a[0]) for a in rows for b in rows
                     if a[0] < b[0] and not (a[2] and b[2])})
    if not breaks:
        return None
    between = [breaks[0] - 1] + [(a + b) / 2 for a, b in zip(breaks, breaks[1:])] + [breaks[-1] + 1]
    sums = [sign_sum(b, rows) for b in between]
    positive = [breaks[i] for i in range(len(breaks)) if sums[i] > 0]
    negative = [breaks[i] for i in range(len(breaks)) if sums[i + 1] < 0]
    return (max(positive) + min(negative)) / 2 if positive and negative else None


def expected(rows):
    slope, n, s0 = slope_brute(rows), len(rows), sign_sum(0.0, rows)
    def ties(keys):
        return [keys.count(k) for k in set(keys)]
    t, u = ties([r[0] for r in rows]), ties([None if r[2] else r[1] for r in rows])
    var = (n * (n - 1) * (2 * n + 5) - sum(k * (k - 1) * (2 * k + 5) for k in t + u)) / 18
    if n > 2:
        var += (sum(k * (k - 1) * (k - 2) for k in t) * sum(k * (k - 1) * (k - 2) for k in u)
                / (9 * n * (n - 1) * (n - 2)))
    if n > 1:
        var += sum(k * (k - 1) for k in t) * sum(k * (k - 1) for k in u) / (2 * n * (n - 1))
    p = None
    if var > 1e-12 * n ** 3:
        p = min(2 * (1 - NormalDist().cdf(max(abs(s0) - 1, 0) / math.sqrt(var))), 1.0)
    intercept = None if slope is None else km_brute([(y - slope * x, c) for x, y, c in rows])[1]
    return slope, intercept, (s0 / (n * (n - 1) / 2) if n > 1 else None), p


def frame(spark, groups):
    rows = [(g, x, y if c else None, None if c else y, c) for g, pts in groups.items() for x, y, c in pts]
    return spark.createDataFrame(rows, "parameter string, year int, mdl double, value double, below_mdl boolean"
                                 ).withColumn("stream", F.lit("s"))


def groups_of(seed, count, size):
    rng = random.Random(seed)
    out = {}
    for g in range(count):
        out[f"g{g}"] = [(rng.randint(1993, 1999), float(rng.choice([1, 2, 3, 5, 8, 13])), rng.random() < 0.3)
                        for _ in range(rng.randint(2, size))]
    out["same_x"] = [(2000, 1.0, False), (2000, 2.0, False)]
    out["hidden"] = [(2000, 1.0, True), (2001, 2.0, True)]
    out["single"] = [(2000, 1.0, False)]
    return out


def check(got, groups, tolerance):
    for g, rows in groups.items():
        slope, _, tau, p = expected(rows)
        assert close(got[g]["slope"], slope, tolerance), g
        assert close(got[g]["tau"], tau) and close(got[g]["p"], p, 1e-6), g
        assert got[g]["n"] == len(rows)


@pytest.mark.parametrize(("seed", "count", "size", "pairs"), [(7, 60, 14, 1 << 18), (8, 12, 40, 20)])
def test_slopes(spark, seed, count, size, pairs):
    """The same slopes and intercepts, on tied data, from complete lists and from brackets narrowed in rounds."""
    groups = groups_of(seed, count, size)
    got = {r["parameter"]: r for r in trend.censored_trend(frame(spark, groups), list_pairs=pairs).collect()}
    check(got, groups, 1e-9)
    for g, rows in groups.items():
        assert close(got[g]["intercept"], expected(rows)[1], 1e-9), g


def test_slope_of_a_heavy_tie(spark):
    """Most pairs have the very slope that is asked for, more than a list may hold."""
    line = [(1990 + i % 40, float(i % 40) / 3, False) for i in range(40)]
    rng = random.Random(5)
    groups = {"line": line + [(rng.randint(1990, 2029), rng.uniform(0, 14), rng.random() < 0.3) for _ in range(25)],
              "flat": [(1990 + i, 2.0, i % 3 == 0) for i in range(60)]}
    got = {r["parameter"]: r for r in trend.censored_trend(frame(spark, groups), list_pairs=50).collect()}
    check(got, groups, 1e-9)


def test_empty_table(spark):
    assert trend.censored_trend(frame(spark, {"g": [(2000, 1.0, False)]}).limit(0)).collect() == []


def test_eligible(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 2), ("b", 1), ("b", 1), ("b", 1)], "g string, x int")
    assert {r["g"] for r in trend.eligible(df, ["g"], "x", 3).collect()} == {"a"}
    assert {r["g"] for r in trend.eligible(df, ["g"], "x", 3, distinct=False).collect()} == {"b"}


def test_changes(spark):
    trends = spark.createDataFrame([("p", "a", 1.0, 0.01), ("p", "b", -0.2, 0.2), ("p", "c", -8.0, 0.001)],
                                   "parameter string, stream string, slope double, p double")
    means = spark.createDataFrame([("p", "a", 10.0), ("p", "b", 10.0), ("p", "c", 10.0)],
                                  "parameter string, stream string, grand_mean double")
    got = {r["stream"]: r for r in trend.change_classes(trend.decadal_change(trends, means)).collect()}
    assert {s: r["fill"] for s, r in got.items()} == {"a": 3, "b": -2, "c": -4}
    assert close(got["c"]["log_change"], -math.log10(800)) and close(got["a"]["decadal_change"], 100.0)
    assert {r["stream"] for r in trend.significant_trends(trends).collect()} == {"a", "c"}
    assert {r["stream"] for r in trend.significant_trends(trends, falling=True).collect()} == {"c"}
    km = means.withColumnRenamed("grand_mean", "mean")
    falling = {r["stream"]: r["pct_change"] for r in trend.proportional_change(trends, km).collect()}
    assert close(falling["c"], 0.8)


def test_loglog_band(spark):
    rng = np.random.default_rng(9)
    x = rng.lognormal(size=12)
    y = 3 * x ** 0.7 * rng.lognormal(sigma=0.2, size=12)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    got = trend.loglog_regression(df, "x", "y", ["g"]).collect()
    lx, ly = np.log10(x), np.log10(y)
    slope, intercept = np.polyfit(lx, ly, 1)
    s = math.sqrt(np.sum((ly - intercept - slope * lx) ** 2) / 10)
    for r in got:
        a = math.log10(r["x"])
        half = 1.812461 * s * math.sqrt(1 / 12 + (a - lx.mean()) ** 2 / np.sum((lx - lx.mean()) ** 2))
        fit = intercept + slope * a
        assert r["fit"] == pytest.approx(10 ** fit) and r["lower"] == pytest.approx(10 ** (fit - half), rel=1e-5)
        assert r["upper"] == pytest.approx(10 ** (fit + half), rel=1e-5)


def test_local_smooth(spark):
    rng = np.random.default_rng(10)
    x, y = rng.uniform(0, 10, 40).round(1), rng.normal(size=40)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    got = sorted((r["x"], r["y"]) for r in trend.local_smooth(df, "x", "y", ["g"], grid_points=7).collect())
    for g, fitted in got:
        d = np.abs(x - g)
        reach = np.sort(d)[int(0.75 * 40) - 1]
        w = np.where(d < reach, (1 - (d / reach) ** 3) ** 3, 0.0)
        assert fitted == pytest.approx(np.polyval(np.polyfit(x - g, y, 2, w=np.sqrt(w)), 0), abs=1e-7)


def smoothed_brute(x, y, g, span):
    d = np.abs(x - g)
    reach = np.sort(d)[max(1, int(span * len(x) + 1e-5)) - 1]
    w = np.where(d < reach, (1 - (d / reach) ** 3) ** 3, 0.0)
    return np.polyval(np.polyfit(x - g, y, 2, w=np.sqrt(w)), 0)


@pytest.mark.parametrize("blocks,part", [(8, 4), (50, 64), (512, 65_536)])
def test_local_smooth_by_blocks(spark, monkeypatch, blocks, part):
    """Blocks of many x, of one heavy x, parts of few positions, a null group, a group with one x."""
    monkeypatch.setattr(smooth, "BLOCKS", blocks)
    monkeypatch.setattr(smooth, "PART_ROWS", part)
    rng = np.random.default_rng(31)
    groups = {"even": rng.uniform(-3, 5, 400), "tied": rng.integers(0, 12, 300).astype(float),
              "heavy": np.append(np.full(200, 2.5), rng.uniform(0, 9, 250)), None: 1e6 + rng.exponential(2.0, 300)}
    y = {k: np.sin(x - x.min()) + rng.normal(size=len(x)) for k, x in groups.items()}
    rows = [(k, float(a), float(b)) for k, x in groups.items() for a, b in zip(x, y[k])]
    rows += [("one", 4.0, 1.0), ("one", 4.0, 2.0), ("even", None, 1.0), ("even", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for span, grid in ((0.75, 9), (0.4, 80)):
        got = smooth.local_smooth(df, "x", "y", ["g"], span, grid).collect()
        assert {r["g"] for r in got} == set(groups)
        for k, x in groups.items():
            mine = sorted((r["x"], r["y"]) for r in got if r["g"] == k)
            near = [g for g in np.linspace(x.min(), x.max(), grid)
                    if (np.unique(x[np.abs(x - g) < np.sort(np.abs(x - g))[int(span * len(x) + 1e-5) - 1]]).size > 2)]
            values = {round(g, 6): v for g, v in mine}
            for g in near:
                assert values[round(float(g), 6)] == pytest.approx(smoothed_brute(x, y[k], g, span), abs=1e-6), (k, span, g)


def test_local_smooth_looks_at_few_rows(spark):
    """Detail rows that meet a grid point are a small share of rows by grid points."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 0.37 % 1000).alias("x"), F.rand(3).alias("y"))
    out = smooth.local_smooth(df, "x", "y", ["g"])
    assert out.count() == 80
    assert spark.createDataFrame([], df.schema).transform(lambda d: smooth.local_smooth(d, "x", "y", ["g"])).count() == 0


def test_grid_and_facets(spark):
    trends = spark.createDataFrame([("p", "a", 2.0, 1.0)], "parameter string, stream string, slope double, intercept double")
    df = spark.createDataFrame([("p", "a", 1.0, 5.0), ("p", "a", 1.35, 7.0), ("p", "b", 9.0, 99.0)],
                               "parameter string, stream string, x double, y double")
    facets = trend.regression_facets(df, trends, "x", "y").collect()
    assert len(facets) == 2 and close(facets[0]["y_max"], 7.7)
    bounds = spark.createDataFrame([("p", 1.0, 1.35)], "parameter string, x_min double, x_max double")
    got = sorted((round(r["x"], 6), round(r["y"], 6)) for r in trend.regression_grid(trends, bounds).collect())
    assert got == [(1.0, 3.0), (1.1, 3.2), (1.2, 3.4), (1.3, 3.6)]
