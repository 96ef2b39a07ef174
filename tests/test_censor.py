import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestat.operators import censor
from lodestat.sources import testbed
from tests.conftest import close, measured


def settle(rows):
    """Brute force: walk the limits of each group upwards and keep every settled value."""
    by_param = defaultdict(list)
    for r in rows:
        by_param[r[1]].append(r)
    out = {}
    for parameter, members in by_param.items():
        if all(r[4] for r in members):
            continue
        lowest = min(r[2] for r in members if r[2] is not None)
        for stream in {r[0] for r in members}:
            group = [r for r in members if r[0] == stream]
            values = [r[3] for r in group if r[3] is not None]
            settled, seen = [], 0
            for level in sorted({r[2] for r in group if r[2] is not None}):
                here = [r for r in group if r[2] == level]
                below = sum(r[4] for r in here)
                smaller = [v for v in settled if v < level]
                share = "<40%" if below / len(here) < 0.4 else ">40%"
                rule = level if share == "<40%" else level / 2
                if level == lowest:
                    rep, qual = rule, f"LowestMDL, {share}"
                elif not values or level >= max(values):
                    rep, qual = None, "HighNonDetect"
                elif smaller:
                    rep, qual = sum(smaller) / len(smaller), "LowerMean"
                else:
                    rep, qual = rule, ("LowerData>MDL" if seen else "NoLowerData") + f", {share}"
                out[stream, parameter, level] = (rep, qual)
                seen += len(here)
                settled += [rep if r[4] else r[3] for r in here
                            if (rep if r[4] else r[3]) is not None]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_replacement_levels(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(60):
        levels = rng.sample([0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0], rng.randint(1, 5))
        for _ in range(rng.randint(1, 12)):
            mdl = rng.choice(levels)
            below = rng.random() < rng.choice([0.2, 0.6, 0.9])
            value = None if below or rng.random() < 0.1 else rng.choice([0.15, 0.3, 0.7, 1.5, 3.0, 7.0])
            rows.append((f"s{g}", f"p{g % 9}", mdl, value, below))
    want = settle(rows)
    got = {(r["stream"], r["parameter"], r["mdl"]): (r["replacement"], r["rvqual"])
           for r in censor.replacement_levels(measured(spark, rows)).collect()}
    assert set(got) == set(want)
    for key, (rep, qual) in want.items():
        assert got[key][1] == qual, key
        assert close(got[key][0], rep), key


def test_all_qualifiers_by_hand(spark):
    rows = ([("a", "p", 0.1, None, True)] + [("a", "p", 0.1, 0.3, False)] * 3 +
            [("a", "p", 0.5, None, True), ("a", "p", 1.0, None, True), ("a", "p", 1.0, 9.0, False)] +
            [("a", "p", 20.0, None, True)] +
            [("b", "p", 0.2, None, True), ("b", "p", 0.2, 7.0, False), ("b", "p", 0.2, 7.0, False),
             ("b", "p", 0.5, 8.0, False)] +
            [("c", "p", 0.2, 6.0, False), ("c", "p", 0.5, None, True), ("c", "p", 0.5, 6.0, False)])
    got = {(r["stream"], r["mdl"]): (r["rvalue"], r["rvqual"])
           for r in censor.replace_nondetects(measured(spark, rows)).filter("below_mdl").collect()}
    assert got[("a", 0.1)] == (0.1, "LowestMDL, <40%")
    assert got[("a", 0.5)][1] == "LowerMean" and close(got[("a", 0.5)][0], (0.1 + 0.9) / 4)
    assert got[("a", 1.0)][1] == "LowerMean"
    assert got[("a", 20.0)] == (None, "HighNonDetect")
    assert got[("b", 0.2)] == (0.2, "NoLowerData, <40%")
    assert got[("c", 0.5)] == (0.25, "LowerData>MDL, >40%")


def test_rows_without_limit_or_group_vanish(spark):
    rows = [("a", "p", None, 3.0, False), ("a", "p", 1.0, 3.0, False), (None, "p", 1.0, 3.0, False),
            ("a", "hidden", 1.0, None, True)]
    got = censor.replace_nondetects(measured(spark, rows)).collect()
    assert len(got) == 1 and got[0]["rvalue"] == 3.0


def replicate_rows(spark, rows):
    day = dt.date(2000, 1, 1)
    full = [(day, 2000, 1, "wet weather", "loc", st, "pos", "FDL", "Metal", "Zinc, Total", "Zn", "ug/L",
             v, q, m, i) for i, (st, v, q, m) in enumerate(rows)]
    df = spark.createDataFrame(full, "date date, year int, month int, routine string, locator string, "
                               "stream string, position string, loc_group string, metal_org string, "
                               "parameter string, parmname string, units string, value double, qual string, "
                               "mdl double, row int")
    return df.withColumns({"rdl": F.col("mdl") * 2, "hardness": F.lit(None).cast("double"),
                           "textvalue": F.col("row").cast("string")})


def test_replicates(spark):
    rows = [("a", 5.0, None, 0.1), ("a", None, "<MDL", 0.1), ("a", 7.0, None, 0.1),
            ("b", None, "<MDL", 0.1), ("b", None, "<MDL", 0.3), (None, 1.0, None, 1.0)]
    got = {r["stream"]: r for r in censor.average_replicates(
        censor.flag_censored(replicate_rows(spark, rows)), ["row"]).collect()}
    assert got["a"]["mdl"] == 0.1 and got["a"]["value"] == 6.0 and not got["a"]["below_mdl"]
    assert got["a"]["sample"] == "3" and got["a"]["qual"] is None and got["a"]["textvalue"] == "0"
    assert got["b"]["below_mdl"] and got["b"]["value"] is None and got["b"]["mdl"] == 0.2
    assert None in got and got["a"]["hardness"] is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicates_reach_one_sort_by_one_shuffle(spark, monkeypatch):
    rows = [(f"s{i % 40}", float(i), None, 0.1) for i in range(100)]
    monkeypatch.setattr(censor, "PART_ROWS", 50, raising=False)
    got = censor.average_replicates(censor.flag_censored(replicate_rows(spark, rows)), ["row"], crowded=64)
    plan = plan_of(got)
    # nothing is sorted for the sake of combining rows before the shuffle, and the rows decide on its parts
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("Aggregate") and ", 2), REPARTITION_BY_NUM" in plan
    assert sum(int(r["sample"]) for r in got.collect()) == 100


def test_replicates_with_constant_keys_are_sorted_once(spark):
    rows = [(f"s{i % 40}" if i % 3 else None, float(i), None, 0.1) for i in range(100)]
    df = censor.flag_censored(replicate_rows(spark, rows))
    constant = df.withColumns({"metal_org": F.lit("Metal"), "units": F.lit("ug/L")})
    got = censor.average_replicates(constant, ["row"])
    assert plan_of(got).count("Sort [") == 1
    drawn = df.withColumns({"metal_org": F.concat(F.lit("Met"), F.lower(F.lit("AL")), F.substring("date", 1, 0)), "units": F.lit("ug/L")})
    assert got.columns[:12] == censor.REPLICATE_KEYS
    assert sorted(map(str, got.collect())) == sorted(map(str, censor.average_replicates(drawn, ["row"]).collect()))


def test_crowded_replicate_sets_are_combined_before_the_shuffle(spark):
    rows = [("a", float(i % 7), None, 0.1) for i in range(300)] + [(None, 2.0, None, 0.2)] * 200 + [
        ("b", 1.0, None, 1.0), ("b", 3.0, "<RDL", 1.0), ("c", None, "<MDL", 4.0)]
    df = censor.flag_censored(replicate_rows(spark, rows))
    crowded, plain = (censor.average_replicates(df, ["row"], crowded=n) for n in (64, 10_000))
    assert "Union" in plan_of(crowded) and "Union" not in plan_of(plain)
    as_rows = lambda d: sorted(map(str, d.withColumns({c: F.round(c, 9) for c in ("value", "rdl")}).collect()))
    assert as_rows(crowded) == as_rows(plain) and len(as_rows(plain)) == 4


def test_places_join_by_their_measured_size(spark, tmp_path):
    spark.range(3000).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "CAST(id % 25 AS INT) AS s_nationkey"
                                 ).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(25).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name", "CAST(id % 5 AS INT) AS n_regionkey"
                               ).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(9000).selectExpr("id AS l_suppkey", "1 AS l_linenumber", "timestamp'2000-01-01' AS l_shipdate", "0.05D AS l_discount"
                                 ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = testbed.oxygen(spark, str(tmp_path))
    assert "SortMergeJoin" not in plan_of(got) and got.count() == 3000


def test_sparse_streams_keep_missing(spark):
    df = spark.createDataFrame([("Lyon Creek B",), (None,), ("Eden Creek",)], "stream string")
    assert censor.drop_sparse_streams(df).count() == 2


def test_split_and_forty_percent(spark):
    rows = [("a", "x", 1.0, None, True), ("a", "x", 2.0, None, True), ("a", "y", 1.0, 5.0, False),
            ("a", "y", 1.0, None, True), ("a", "y", 1.0, 6.0, False)]
    kept, hidden = censor.split_all_nondetect(measured(spark, rows))
    assert {r["parameter"] for r in kept.collect()} == {"y"}
    assert sorted((r["rvalue"], r["rvqual"]) for r in hidden.collect()) == [
        (0.5, "AllNonDetect"), (1.0, "AllNonDetect")]
    got = [(r["rvalue"], r["rvqual"]) for r in censor.substitute_40pct(
        measured(spark, rows)).filter("parameter = 'y' AND below_mdl").collect()]
    assert got == [(1.0, "LowestMDL, <40%")]


def test_flip_uses_limits_above_all_values(spark):
    rows = [("a", "p", 1.0, 5.0, False), ("a", "p", 60.0, None, True)]
    got = sorted(r["flip_value"] for r in censor.flip_values(measured(spark, rows), ["parameter"]).collect())
    assert got == [10.0, 65.0]


def test_limit_history(spark):
    rows = [("p", y, m) for y, m in [(1993, 1.0), (1994, 1.0), (1995, 0.5), (1996, 2.0), (1997, 0.2)]]
    df = spark.createDataFrame(rows, "parameter string, year int, mdl double")
    got = sorted((r["lowest"], r["from_year"], r["to_year"]) for r in censor.mdl_year_ranges(df).collect())
    assert got == [(0.2, 1997, 1997), (0.5, 1995, 1997), (1.0, 1993, 1995)]
    yearly = {r["year"]: r for r in censor.mdl_by_year(df).collect()}
    assert yearly[1995]["lowest"] == 0.5 and yearly[1995]["count"] == 1


def test_reports(spark):
    rows = [("a", "p", 1.0, None, True), ("a", "p", 1.0, 2.0, False), ("b", "p", 2.0, None, True),
            ("b", "q", 2.0, 3.0, False)]
    df = measured(spark, rows)
    report = censor.censoring_report(df)
    assert {r["parameter"]: round(r["percent_below_mdl"]) for r in report["parameter"].collect()} == {
        "p": 67, "q": 0}
    assert report["stream_mdl"].count() == 3
    assert censor.rare_detects(df).count() == 1
    cover = spark.createDataFrame([("Metal", "p", 2000, s) for s in "aaabc"] + [("Other", "p", 2000, "z")],
                                  "metal_org string, parameter string, year int, stream string")
    r = censor.sampling_coverage(cover).first()
    assert (r["num_samples"], r["num_streams"], r["n_per_stream"]) == (5, 3, 1.0)
