import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import ordered


@pytest.mark.parametrize("size", [150, 65_536])
def test_running_totals_on_a_hot_group(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "SLICE_ROWS", size)
    rng = random.Random(2)
    rows = [("hot", round(rng.lognormvariate(0, 2) * rng.choice([-1, 1]), 6), 1 + i % 3)
            for i in range(3000)] + [("cold", float(i), 2) for i in range(5)] + [(None, 1.5, 7)]
    points = spark.createDataFrame(rows, "g string, v double, w long").groupBy("g", "v").agg(
        F.sum("w").alias("w"))
    got = ordered.running_totals(points, ["g"], "v", ["w"]).collect()
    weights: dict = {}
    for g, v, w in rows:
        weights.setdefault(g, {}).setdefault(v, 0)
        weights[g][v] += w
    assert len(got) == sum(len(x) for x in weights.values())
    want = {}
    for g, vs in weights.items():
        before = 0
        for v in sorted(vs):
            want[g, v] = (before, sum(vs.values()))
            before += vs[v]
    assert {(r["g"], r["v"]): (r["w_before"], r["w_all"]) for r in got} == want


@pytest.mark.parametrize("column", ["close", "equal", "label", "wide"])
def test_hot_group_is_cut_into_slices(spark, monkeypatch, column):
    """Values within a millionth, equal values, texts that agree in 20 characters, values over many powers."""
    monkeypatch.setattr(ordered, "SLICE_ROWS", 500)
    df = spark.range(20000).select(
        F.lit("g").alias("g"), "id", (1 + F.col("id") / 1e11).alias("close"), F.lit(1.0).alias("equal"),
        F.concat(F.lit("a" * 20), F.col("id")).alias("label"), F.pow(F.lit(1.01), F.col("id") % 4000).alias("wide"))
    for keys in (["g"], []):
        sizes = [r["count"] for r in ordered.sliced(df, keys, column).groupBy("_slice").count().collect()]
        assert max(sizes) < 1500 and len(sizes) > 15
    got = ordered.ordinal_positions(df, ["g"], column, ["id"]).collect()
    assert sorted(r["position"] for r in got) == list(range(1, 20001)) and {r["group_size"] for r in got} == {20000}
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == [
        r["id"] for r in sorted(df.collect(), key=lambda r: (r[column], r["id"]))]


def test_small_groups_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    rows = [("big", float(i % 7), 1) for i in range(3000)] + [(g, 2.0, 5) for g in "abc"] + [(None, 1.0, 2), (None, 1.0, 3)]
    cut = ordered.sliced(spark.createDataFrame(rows, "g string, v double, w long"), ["g"], "v")
    assert {(r["g"], r["_slice"] is None) for r in cut.select("g", "_slice").distinct().collect()} == {
        ("big", False), ("a", True), ("b", True), ("c", True), (None, True)}
    got = ordered.running_totals(cut, ["g"], "v", ["w"], cut=False)
    again = ordered.running_totals(got.withColumn("u", F.col("w_before") * 0 + 1), ["g"], "v", ["u"], cut=False).collect()
    big = sorted((r for r in again if r["g"] == "big"), key=lambda r: r["u_before"])
    assert [r["u_before"] for r in big] == list(range(3000)) == [r["w_before"] for r in big]
    assert {(r["g"], r["w_all"]) for r in again} == {("big", 3000), ("a", 5), ("b", 5), ("c", 5), (None, 5)}


@pytest.mark.parametrize("seed", [3, 4])
def test_exact_quantiles(spark, monkeypatch, seed):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100 if seed == 3 else 65_536)
    rng = np.random.default_rng(seed)
    rows = [("a", float(v)) for v in rng.lognormal(size=501)] + [("b", float(v)) for v in
            rng.integers(0, 4, 40)] + [("c", 2.5), ("d", None)]
    got = {r["g"]: r for r in ordered.exact_quantiles(
        spark.createDataFrame(rows, "g string, v double"), ["g"], "v",
        {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in "abc":
        vs = [v for k, v in rows if k == g]
        for name, p in (("q1", 25), ("m", 50), ("q9", 90)):
            assert got[g][name] == pytest.approx(np.percentile(vs, p), rel=1e-12)


def test_ranks(spark):
    """Positions are 64 bits wide."""
    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("a", 4.5), ("c", 5.0), ("d", None)],
                               "k string, v double")
    got = {r["k"]: r["rank"] for r in ordered.rank_categories(df, "k", "v").collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4}
    got = {r["k"]: r["rank"] for r in ordered.alphabetical_rank(df, "k").collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4}
    levels = ordered.sorted_levels(df, [], "v").orderBy("level").collect()
    assert [(r["v"], r["level"]) for r in levels] == [(1.0, 1), (4.5, 2), (5.0, 3)]
    assert dict(ordered.alphabetical_rank(df, "k").dtypes)["rank"] == "bigint"


def test_many_labels_are_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 200)
    labels = [f"{'é' * 18}{i * 7919 % 3001:05d}" for i in range(3001)]
    df = spark.createDataFrame([(x,) for x in labels + labels[:50] + [None]], "k string")
    got = {r["k"]: r["rank"] for r in ordered.alphabetical_rank(df, "k").collect()}
    assert got == {x: i for i, x in enumerate(sorted(labels), 1)}
