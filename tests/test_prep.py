import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestat.operators import prep


def test_stream_names(spark):
    rows = [("a", "Lyon Creek", "Other 1"), ("b", "Lyon Creek", "OTHER 2"), ("c", "Lyon Creek", None),
            ("d", "Lyon Creek", "FDL")]
    df = spark.createDataFrame(rows, "LOCATOR string, STREAM string, `Reporting Group` string")
    got = {r["LOCATOR"]: r["STREAM"] for r in prep.disambiguate_streams(df).collect()}
    assert got == {"a": "Lyon Creek B", "b": "Lyon Creek C", "c": None, "d": "Lyon Creek"}


def chem(spark, rows):
    return spark.createDataFrame([(s, dt.date(2000, 1, 1), p, n, v) for s, p, n, v in rows],
                                 "sample string, date date, parameter string, parmname string, value double")


def test_hardness(spark):
    rows = [("s1", "Calcium, Total", "Ca", 10000.0), ("s1", "Magnesium, Total", "Mg", 2000.0),
            ("s2", "Calcium, Total", "Ca", 10000.0), ("s2", None, "Hardness, Calc", 40.0),
            ("s3", None, "Hardness, Calc", 55.0), ("s4", "Zinc, Total", "Zn", 1.0),
            ("s1", None, "Hardness, Calc", 99.0)]
    got = {r["sample"]: r["hardness"] for r in prep.derive_hardness(chem(spark, rows)).collect()}
    assert got["s1"] == pytest.approx((10000 * 2.497 + 2000 * 4.118) / 1000)
    assert got["s2"] == 40.0 and got["s3"] == 55.0 and got["s4"] is None


def test_hardness_duplicates(spark):
    rows = [("s1", "Calcium, Total", "Ca", 1000.0), ("s1", "Calcium, Total", "Ca", 3000.0),
            ("s1", "Magnesium, Total", "Mg", 0.0)]
    df = chem(spark, rows)
    with pytest.raises(Exception, match="more than one row"):
        prep.derive_hardness(df).collect()
    assert prep.derive_hardness(df, "mean").first()["hardness"] == pytest.approx(2000 * 2.497 / 1000)


def test_audit(spark):
    day = dt.date(2000, 1, 1)
    base = ("Metal", day, "loc", "st", "s1")
    rows = [(*base, "Zinc, Dissolved", 5.0, "<RDL", None), (*base, "Zinc, Total", 4.0, "<RDL", None),
            (*base, "Iron, Dissolved", 5.0, None, None), (*base, "Iron, Total", 2.0, "<RDL", None),
            (*base, "Lead, Dissolved", 1.0, None, None), (*base, "Lead, Total", 2.0, None, None)]
    df = spark.createDataFrame(rows, "metal_org string, date date, locator string, stream string, "
                               "sample string, parameter string, value double, qual string, textvalue string")
    got = {r["metal"]: (r["pct_dissolved"], r["both_below_rdl"])
           for r in prep.audit_dissolved_over_total(df).collect()}
    assert got == {"Zinc": (125.0, True), "Iron": (250.0, False)}


def test_lookups_fan_out(spark):
    final = spark.createDataFrame(
        [("L1", "A", "p", "FDL", "z", "Metal", "Zinc, Total", "2/8/96", "STORM"),
         ("L1", "A", "p", "Other 1", "z", "Metal", "Zinc, Total", "2/8/96", "ROUTINE")],
        "LOCATOR string, STREAM string, `POSITION ON STREAM` string, `Reporting Group` string, "
        "PARMNAME string, `GROUP 1` string, `GROUP 2` string, COLLECTDATE string, "
        "`SAMPLE TYPE (ROUTINE/STORM)` string")
    assert prep.location_lookup(final).count() == 2
    assert prep.parameter_lookup(final).count() == 1
    assert prep.date_lookup(final, F.col("COLLECTDATE")).count() == 2
    raw = spark.createDataFrame([("L47", 1.5)], "LABSAMPLENUM string, NUMVALUE double")
    assert prep.to_canonical(raw).columns == ["sample", "value"]
    assert prep.bad_rows(spark).count() == 10
