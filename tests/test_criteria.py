import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lodestat.operators import criteria


def judged(spark, rows, table=None):
    day = dt.date(2000, 5, 1)
    df = spark.createDataFrame(
        [(p, s, day, "wet weather", v, m, b, h) for p, s, v, m, b, h in rows],
        "parameter string, stream string, date date, routine string, rvalue double, mdl double, "
        "below_mdl boolean, hardness double")
    return criteria.exceedance_ratios(criteria.attach_criteria(df, criteria.criteria_table(spark, table)))


def test_formulas(spark):
    h = 50.0
    got = {r["parameter"]: r for r in judged(spark, [(p, "a", 1.0, 0.1, False, h) for p in (
        "Cadmium, Dissolved", "Lead, Dissolved", "Silver, Dissolved", "Mercury, Dissolved", "Mercury, Total",
        "Arsenic, Total", "Gold, Total")]).collect()}
    ln = math.log(h)
    assert got["Cadmium, Dissolved"]["acute"] == pytest.approx((1.136672 - ln * 0.041838) * math.exp(1.128 * ln - 3.828))
    assert got["Cadmium, Dissolved"]["chronic"] == pytest.approx((1.101672 - ln * 0.041838) * math.exp(0.7852 * ln - 3.49))
    assert got["Lead, Dissolved"]["chronic"] == pytest.approx((1.46203 - ln * 0.145712) * math.exp(1.273 * ln - 4.705))
    assert got["Silver, Dissolved"]["acute"] == pytest.approx(0.85 * math.exp(1.72 * ln - 6.52))
    assert got["Silver, Dissolved"]["chronic"] is None
    assert (got["Mercury, Dissolved"]["acute"], got["Mercury, Dissolved"]["chronic"]) == (2.1, None)
    assert (got["Mercury, Total"]["acute"], got["Mercury, Total"]["chronic"]) == (None, 0.012)
    assert got["Arsenic, Total"]["prop_water"] == pytest.approx(1 / 0.0225)
    assert got["Gold, Total"]["acute"] is None


def test_missing_hardness_gives_no_limit(spark):
    r = judged(spark, [("Zinc, Dissolved", "a", 1.0, 0.1, False, None)]).first()
    assert r["acute"] is None and r["prop_acute"] is None


TABLE = [("X, Total", "acute", None, None, None, None, 10.0), ("X, Total", "water", None, None, None, None, 5.0)]


def test_rates_count_only_informative_nondetects(spark):
    rows = [("X, Total", "a", 20.0, 1.0, False, 1.0), ("X, Total", "a", 6.0, 1.0, False, 1.0),
            ("X, Total", "a", 2.0, 4.0, True, 1.0), ("X, Total", "b", 11.0, 12.0, True, 1.0),
            ("Y, Total", "a", 99.0, 1.0, False, 1.0)]
    df = judged(spark, rows, TABLE)
    r = criteria.exceedance_rates(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["acute_n"], r["acute_over"], round(r["acute_pct"], 3)) == (3, 1, 33.333)
    assert (r["water_n"], r["water_over"]) == (3, 2) and (r["chronic_n"], r["chronic_over"]) == (2, 0)
    assert [x["stream"] for x in criteria.exceedance_rates(df, ["parameter", "stream"]).collect()] == ["a"]
    assert criteria.exceedances(df, "aquatic").count() == 1 and criteria.exceedances(df, "human").count() == 2
    human = criteria.report_table("human", criteria.exceedance_rates(df)).first()
    assert human["water_pct"] == 66.7
    assert criteria.report_table("aquatic", criteria.exceedance_rates(df)).first()["acute_pct"] == 33.3


def test_silver_appears_among_fixed_values(spark):
    rows = [("Silver, Dissolved", "a", 1.0, 0.1, False, h) for h in (20.0, 30.0)]
    assert criteria.fixed_criteria(judged(spark, rows)).count() == 2
    assert criteria.fixed_criteria(judged(spark, rows), ["Silver, Dissolved"]).count() == 0


def test_summary(spark):
    rows = [("Copper, Dissolved", "a", 1.0, 0.1, False, h) for h in (10.0, 20.0, 40.0, 80.0)]
    r = criteria.criteria_summary(judged(spark, rows)).first()
    acute = [0.96 * math.exp(0.9422 * math.log(h) - 1.464) for h in (10, 20, 40, 80)]
    assert r["min_acute"] == pytest.approx(acute[0]) and r["max_acute"] == pytest.approx(acute[3])
    assert r["median_acute"] == pytest.approx((acute[1] + acute[2]) / 2)
    assert r["mean_acute"] == pytest.approx(sum(acute) / 4)


def test_points(spark):
    rows = [("X, Total", "a", 20.0, 1.0, False, 1.0), ("X, Total", "a", 3.0, 6.0, True, 1.0),
            ("X, Total", "a", 9.0, 40.0, True, 1.0), ("X, Total", "b", 4.0, 1.0, False, 1.0)]
    got = criteria.criteria_points(judged(spark, rows, TABLE), "aquatic", "X, Total").collect()
    assert sorted(r["rvalue"] for r in got) == [3.0, 20.0]
    assert {r["above_criteria"] for r in got} == {True, False} and got[0]["y_max"] == pytest.approx(22.0)
    human = criteria.criteria_points(judged(spark, rows, TABLE), "human")
    assert human.count() == 1 and human.first()["y_min"] == pytest.approx(4.5)
    with pytest.raises(ValueError):
        criteria.criteria_pair(human, "other")


def test_limits_reach_the_rows_without_a_shuffle(spark):
    rows = spark.range(100).selectExpr("concat('p', id) AS parameter", "double(id) AS hardness", "double(id) AS value")
    plan = criteria.attach_criteria(rows.select("parameter", "hardness"), criteria.criteria_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(parameter" not in plan
