import pytest
from pyspark.sql import functions as F

from lodestat.operators import relate


def test_null_keys_match(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20), (None, 21)], "k string, w int")
    got = sorted((r["v"], r["w"] or 0) for r in relate.attach(left, right, ["k"]).collect())
    assert got == [(1, 10), (2, 20), (2, 21), (3, 0)]
    assert sorted(r["v"] for r in relate.semi(left, right, ["k"]).collect()) == [1, 2]
    assert [r["v"] for r in relate.anti(left, right, ["k"]).collect()] == [3]
    full = relate.full_join(left, right.filter("w < 21").union(
        spark.createDataFrame([("z", 99)], "k string, w int")), ["k"])
    assert sorted((str(r["k"]), r["v"] or 0, r["w"] or 0) for r in full.collect()) == [
        ("None", 2, 20), ("a", 1, 10), ("b", 3, 0), ("z", 0, 99)]


def test_exclude_covariate_and_guard(spark):
    df = spark.createDataFrame([("L1", "Zinc, Total"), ("L1", "Iron, Total")], "sample string, parameter string")
    bad = spark.createDataFrame([("L1", "Zinc, Total")], df.schema)
    assert [r["parameter"] for r in relate.exclude(df, bad).collect()] == ["Iron, Total"]
    lookup = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    assert relate.assert_unique(lookup.filter("v = 1"), ["k"]).count() == 1
    with pytest.raises(Exception, match="not unique"):
        relate.assert_unique(lookup, ["k"]).collect()


def test_sort_puts_missing_last_and_rows_bind_by_name(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    assert [r["a"] for r in relate.arrange(df, "a").collect()] == [1, 2, None]
    assert [r["a"] for r in relate.arrange(df, "-a").collect()] == [2, 1, None]
    both = relate.bind_rows(df, spark.createDataFrame([("x",)], "b string"))
    assert both.columns == ["a", "b"] and both.filter(F.col("b") == "x").first()["a"] is None
