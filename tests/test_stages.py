import datetime as dt

from checks import stages


def test_comparison_stores_only_what_it_reads(spark, monkeypatch):
    def rows(routine):
        return spark.createDataFrame(
            [("s", "p", routine, dt.date(2000, 1, d), float(d), False, 1.0, float(d), "note") for d in range(1, 6)],
            "stream string, parameter string, routine string, date date, value double, below_mdl boolean, "
            "mdl double, rvalue double, textvalue string")
    monkeypatch.setattr(stages, "storm", lambda *_: rows("wet weather"))
    monkeypatch.setattr(stages, "base", lambda *_: rows("Routine"))
    got = stages.compared(spark, "rows of this test")
    assert got.count() == 10 and "textvalue" not in got.columns
