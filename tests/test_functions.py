import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from lodestat import functions as fn


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_missing_condition_gives_missing(spark):
    got = values(spark, "c boolean", [(True,), (False,), (None,)],
                 fn.r_ifelse(F.col("c"), F.lit(1), F.lit(2)))
    assert got == [(1,), (2,), (None,)]


def test_membership_is_never_missing(spark):
    got = values(spark, "c string", [("a",), ("b",), (None,)],
                 fn.r_isin(F.col("c"), ["a"]), fn.r_not_isin(F.col("c"), ["a"]))
    assert got == [(True, False), (False, True), (False, True)]


def test_case_chain_later_wins_and_null_propagates(spark):
    c = F.col("c")
    got = values(spark, "c double", [(0.5,), (1.5,), (12.0,), (None,)],
                 fn.case_chain([(c > 1, 1), (c > 2, 2), (c > 10, 4)]))
    assert got == [(None,), (1,), (4,), (None,)]


def test_clamp_keeps_null_and_caps(spark):
    assert values(spark, "c double", [(120.0,), (20.0,), (None,)],
                  fn.clamp(F.col("c"), 100.0)) == [(100.0,), (20.0,), (None,)]


def test_defaults(spark):
    got = values(spark, "a string, b string", [(None, "x"), ("y", "x")],
                 fn.default_to(F.col("a"), "d"), fn.fallback(F.col("a"), F.col("b")))
    assert got == [("d", "x"), ("y", "y")]


def test_distinct_count_counts_null_once(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", None), ("b", 2)], "g string, v int")
    got = {r[0]: r[1] for r in df.groupBy("g").agg(
        fn.count_distinct_with_null(F.col("v"))).collect()}
    assert got == {"a": 2, "b": 1}


def test_two_digit_years(spark):
    texts = ["2/8/96", "2/8/1996", "02/08/1996 10:30", "2/8/96 9:05", "1/1/68", "", "NA", None, "5/6/2075"]
    got = [r[0] for r in values(spark, "t string", [(t,) for t in texts],
                                fn.parse_lab_date(F.col("t")))]
    day = dt.date(1996, 2, 8)
    assert got == [day, day, day, day, dt.date(2068, 1, 1), None, None, None, dt.date(2075, 5, 6)]


def test_month_shift_clamps(spark):
    got = values(spark, "d date", [(dt.date(2001, 3, 31),)], fn.shift_months(F.col("d"), -1))
    assert got == [(dt.date(2001, 2, 28),)]


def test_text(spark):
    rows = [("Été, Total",), ("Pipers Creek B",), ("Eden Creek",), ("...",), (None,)]
    got = values(spark, "t string", rows, fn.first_word(F.col("t")), fn.stream_label(F.col("t")))
    assert got == [("Été", "Ét"), ("Pipers", "PpB"), ("Eden", "Ed"), (None, ".."), (None, None)]
    sub = values(spark, "t string", [("abcdef",)], fn.str_sub(F.col("t"), 1, 2),
                 fn.str_sub(F.col("t"), -1, -1), fn.str_sub(F.col("t"), 2, -2),
                 fn.str_sub(F.col("t"), -3, -2), fn.paste(F.col("t"), F.lit("x"), sep="-"),
                 fn.paste(F.col("t"), F.lit(None).cast("string")))
    assert sub == [("ab", "f", "bcde", "de", "abcdef-x", None)]


def test_safe_math(spark):
    got = values(spark, "a double, b double", [(1.0, 0.0), (0.0, 0.0), (1.0, 2.0)],
                 fn.ratio(F.col("a"), F.col("b")), fn.safe_ln(F.col("b")), fn.safe_log10(F.col("a")))
    assert got[0] == (None, None, 0.0) and got[1] == (None, None, None)
    assert got[2][0] == 0.5 and math.isclose(got[2][1], math.log(2))
    assert values(spark, "a double", [(0.5,), (1.5,), (2.5,)],
                  fn.round_half_even(F.col("a"))) == [(0.0,), (2.0,), (2.0,)]


def test_normal_distribution(spark):
    exact = NormalDist()
    zs = [-40.0, -9.0, -7.2, -3.0, -0.1, 0.0, 0.3, 2.5, 7.5, 40.0]
    got = values(spark, "z double", [(z,) for z in zs], fn.norm_cdf(F.col("z")))
    for z, (c,) in zip(zs, got):
        assert c == pytest.approx(exact.cdf(z), rel=1e-9, abs=1e-15)
    ps = [1e-12, 1e-4, 0.07, 0.3, 0.5, 0.8, 0.999, 1 - 1e-9]
    got = values(spark, "p double", [(p,) for p in ps], fn.norm_quantile(F.col("p")),
                 fn.lognorm_quantile(F.col("p")))
    for p, (q, e) in zip(ps, got):
        assert q == pytest.approx(exact.inv_cdf(p), rel=1e-9, abs=1e-12)
        assert e == pytest.approx(math.exp(exact.inv_cdf(p)), rel=1e-8)
    assert values(spark, "p double", [(0.0,), (1.0,), (None,)],
                  fn.norm_quantile(F.col("p"))) == [(None,)] * 3


def test_t_quantile_against_published_values(spark):
    # Two-sided 90 % points.
    table = {1: 6.3138, 2: 2.9200, 3: 2.3534, 4: 2.1318, 5: 2.0150, 8: 1.8595, 10: 1.8125,
             30: 1.6973, 120: 1.6577}
    got = values(spark, "n int", [(n,) for n in table], F.col("n"), fn.t_quantile(0.9, F.col("n")))
    for n, t in got:
        assert t == pytest.approx(table[n], abs=6e-5)


def test_t_quantile_to_full_precision(spark):
    """Closed forms for 1, 2 and 4 degrees; two-sided 99 % points; both sides of the change to the expansion."""
    got = dict(values(spark, "n int", [(n,) for n in (0, 1, 2, 3, 4, 10, 999, 1000, 1001, 1002)], F.col("n"), fn.t_quantile(0.99, F.col("n"))))
    assert got[0] is None and got[1] == pytest.approx(math.tan(0.495 * math.pi), rel=1e-12)
    assert got[2] == pytest.approx(0.99 * math.sqrt(2 / (1 - 0.99**2)), rel=1e-12)
    four = math.sqrt(1 - 0.99**2)
    assert got[4] == pytest.approx(2 * math.sqrt(math.cos(math.acos(four) / 3) / four - 1), rel=1e-12)
    assert got[3] == pytest.approx(5.840909309733, rel=1e-11) and got[10] == pytest.approx(3.169272672616, rel=1e-11)
    second = [got[999] - 2 * got[1000] + got[1001], got[1000] - 2 * got[1001] + got[1002]]
    assert second[0] == pytest.approx(second[1], rel=0.01)


def test_numeric_grid_makes_no_long_row(spark):
    df = spark.createDataFrame([(0.0, 1000.0), (5.0, 5.0)], "lo double, hi double")
    grid = fn.numeric_grid(df, F.col("lo"), F.col("hi"), 0.01, "x")
    assert grid.count() == 100_002 and grid.agg(F.max("x")).first()[0] == pytest.approx(1000.0)
    assert grid.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 60_000
    whole = fn.numeric_grid(spark.createDataFrame([(0.0, 3e9)], "lo double, hi double"), F.col("lo"), F.col("hi"), 1.0, "x")
    assert len(whole.take(3)) == 3


def test_numeric_grid(spark):
    df = spark.createDataFrame([(1.0, 1.3), (2.0, 1.0)], "lo double, hi double")
    got = sorted(r["x"] for r in fn.numeric_grid(df, F.col("lo"), F.col("hi"), 0.1, "x").collect())
    assert got == pytest.approx([1.0, 1.1, 1.2, 1.3])
