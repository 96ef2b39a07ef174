import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import explore, fractions, reshape

CELL = "stream string, parameter string, value double"


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], CELL)
    wide = reshape.pivot_parameters(df, ["stream"], "parameter", "value", ["x", "y"])
    assert {r["stream"]: (r["x"], r["y"]) for r in wide.collect()} == {"a": (1.0, 2.0), "b": (3.0, None)}
    long = reshape.unpivot_parameters(reshape.across(wide, ["x", "y"], lambda c: c * 10), ["stream"], ["x", "y"],
                                      drop_null=True)
    assert sorted(r["value"] for r in long.collect()) == [10.0, 20.0, 30.0]
    assert reshape.unpivot_parameters(wide, ["stream"], ["x", "y"]).count() == 4
    twice = df.union(df)
    with pytest.raises(Exception, match="more than one row"):
        reshape.pivot_parameters(twice, ["stream"], "parameter", "value", ["x", "y"]).collect()
    assert reshape.pivot_parameters(twice, ["stream"], "parameter", "value", ["x", "y"], "mean").count() == 2


def test_ratios(spark):
    rows = [("a", "Iron, Total", 4.0), ("a", "Zinc, Total", 2.0), ("a", "Gold, Total", 2.0),
            ("b", "Zinc, Total", 2.0), ("c", "Iron, Total", 0.0), ("c", "Zinc, Total", 1.0)]
    means = spark.createDataFrame(rows, "stream string, parameter string, grand_mean double")
    got = [(r["stream"], r["parameter"], r["ratio"]) for r in reshape.ratio_to_reference(means, "stream").collect()]
    assert got == [("a", "Zinc, Total", 0.5)]
    km = means.withColumnRenamed("grand_mean", "mean").withColumn(
        "all_censored", F.col("parameter") == "Iron, Total")
    r = reshape.km_iron_ratio(km).filter("stream = 'a'").first()
    assert r["mean"] == 0.5 and r["log_mean"] == pytest.approx(math.log10(0.5))
    hidden = reshape.km_iron_ratio(km.withColumn("all_censored", F.col("parameter") == "Zinc, Total"))
    assert hidden.filter("stream = 'a'").first()["mean"] is None


def test_scaling(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("c", "x", None), ("a", "k", 2.0), ("b", "k", 2.0)], CELL)
    z = {(r["stream"], r["parameter"]): r["scaled"] for r in explore.zscore(df, ["parameter"], "value").collect()}
    assert z["a", "x"] == pytest.approx(-math.sqrt(0.5)) and z["a", "k"] is None and z["c", "x"] is None
    m = {(r["stream"], r["parameter"]): r["scaled"] for r in explore.minmax(df, ["parameter"], "value").collect()}
    assert m == {("a", "x"): 0.0, ("b", "x"): 1.0, ("c", "x"): None, ("a", "k"): 0.5, ("b", "k"): 0.5}
    r = explore.ratio_to_group_mean(df.filter("parameter = 'x'"), value="value").filter("stream = 'b'").first()
    assert r["scaled"] == 1.5


def test_heatmap(spark):
    rows = [("a", "x", 1.0, False), ("b", "x", 3.0, False), ("c", "x", None, True), ("a", "y", 5.0, False), ("b", "y", 4.0, False)]
    df = spark.createDataFrame(rows, CELL + ", hidden boolean")
    got = {(r["x"], r["y"]): r for r in explore.heatmap_cells(
        df, method="rescale", grey="hidden", label="value").collect()}
    assert len(got) == 5 and got["c", "x"]["grey"] and got["c", "x"]["value"] is None
    assert got["b", "x"]["value"] == 1.0 and got["b", "x"]["label"] == 3.0
    assert {k[0]: r["x_rank"] for k, r in got.items()} == {"a": 1, "b": 2, "c": 3}
    assert {k[1]: r["y_rank"] for k, r in got.items()} == {"x": 1, "y": 2}
    back = explore.heatmap_cells(df, method="none", reverse=True, reorder_x=False, reorder_y=True)
    assert {r["y"]: r["y_rank"] for r in back.collect()} == {"x": 1, "y": 2}


def test_qq_and_fences(spark):
    rows = [(f"S{i:02d}", "p", float(v)) for i, v in enumerate([5, 1, 4, 4, 9, 30])]
    df = spark.createDataFrame(rows, "stream string, parameter string, mean double")
    got = sorted((r["position"], r["sample"], r["theoretical"]) for r in explore.qq_points(df).collect())
    assert [g[1] for g in got] == [1.0, 4.0, 4.0, 5.0, 9.0, 30.0]
    for i, _, q in got:
        assert q == pytest.approx(NormalDist().inv_cdf((i - 0.375) / 6.25), abs=1e-9)
    logn = explore.qq_points(df, dist="lnorm").filter("position = 1").first()
    assert logn["theoretical"] == pytest.approx(math.exp(got[0][2]))
    r = explore.outlier_fences(df).first()
    q1, q3 = np.percentile([5, 1, 4, 4, 9, 30], [25, 75])
    assert r["fence"] == pytest.approx(q3 + 1.5 * (q3 - q1)) and r["far_fence"] == pytest.approx(q3 + 3 * (q3 - q1))
    box = explore.box_stats(df, ["parameter"], "mean").first()
    assert (box["n"], box["upper"], box["outliers"], box["lower"]) == (6, 9.0, 1, 1.0)
    assert explore.box_outliers(df, ["parameter"], "mean").first()["mean"] == 30.0
    assert explore.box_stats(df, ["parameter"], "mean", log=True).first()["median"] == pytest.approx(
        np.median(np.log10([5, 1, 4, 4, 9, 30])))


def test_annual_flag_needs_only_high_nondetects(spark):
    rows = [("a", "p", 2000, None, 5.0, "HighNonDetect"), ("a", "p", 2000, None, 6.0, "HighNonDetect"),
            ("a", "p", 2001, None, 5.0, "HighNonDetect"), ("a", "p", 2001, 3.0, 1.0, None)]
    df = spark.createDataFrame(rows, "stream string, parameter string, year int, rvalue double, mdl double, rvqual string")
    got = {r["year"]: r for r in explore.annual_summary(df, mdl="median").collect()}
    assert got[2000]["high_non_detect"] and not got[2001]["high_non_detect"]
    assert got[2000]["mdl"] == 5.5 and got[2000]["annual_mean"] is None and str(got[2001]["date"]) == "2001-07-01"


def test_small_reports(spark):
    df = spark.createDataFrame([("FDL", 1.0), ("Other", 2.0), (None, 3.0)], "loc_group string, rvalue double")
    assert [r["rvalue"] for r in explore.other_locations(df, df.limit(0)).collect()] == [2.0]
    pts = spark.createDataFrame([(0.03,)], "mdl double")
    lines = sorted(r["half"] for r in explore.guide_lines(pts).collect())
    assert lines == pytest.approx([0.0005, 0.0055, 0.0105])


def test_fractions(spark):
    rows = [("2000-01-01", "l", "s", "Zinc, Dissolved", 6.0, False), ("2000-01-01", "l", "s", "Zinc, Total", 4.0, False),
            ("2000-01-01", "l", "s", "Iron, Dissolved", 1.0, True), ("2000-01-01", "l", "s", "Iron, Total", 4.0, False)]
    df = spark.createDataFrame(rows, "date string, locator string, stream string, parameter string, rvalue double, "
                               "below_mdl boolean").withColumns({"value": F.col("rvalue"), "sample": F.lit("1")})
    pairs = fractions.partition_fractions(df)
    assert {r["metal"]: (r["pct_dissolved"], r["below_mdl"]) for r in pairs.collect()} == {
        "Zinc": (150.0, False), "Iron": (25.0, True)}
    oxygen = spark.createDataFrame([("l", "2000-01-01", "Dissolved Oxygen, Field", 8.0), ("l", "2000-01-01", "pH", 7.0)],
                                   "locator string, date string, parmname string, value double")
    got = fractions.oxygen_partition(pairs, fractions.oxygen_readings(oxygen)).collect()
    assert [(r["metal"], r["pct_dissolved"], r["do"]) for r in got] == [("Zinc", 100.0, 8.0)]
