"""A small raw export through all three analyses."""

import random

from lodestat import plans
from lodestat.sources import schema

RAW = ["ROWID", "SITE", "LABSAMPLENUM", "COLLECTDATE", "LOCATOR", "PARMNAME", "NUMVALUE", "UNITS",
       "QUALIFIER", "MDL", "RDL", "TEXTVALUE"]


def export(spark):
    rng = random.Random(12)
    raw, final, dates = [], [], set()
    for i in range(60):
        year, storm = 93 + i % 6, i % 2
        date = f"{1 + i % 12}/{1 + i % 28}/{year}"
        for site in ("A1", "B1"):
            for parm, low in (("Copper, Dissolved, ICP", 1.0), ("Iron, Total, ICP", 5.0)):
                value = rng.lognormvariate(2, 1) * (2 if storm else 1) * (1 + 0.2 * (i % 6))
                below = value < low
                raw.append((len(raw), "STREAMS", f"L{i}{site}", f"{date} 10:30", site, parm,
                            None if below else round(value, 2), "ug/L", "<MDL" if below else None,
                            low, 2 * low, None))
            raw.append((len(raw), "STREAMS", f"L{i}{site}", f"{date} 10:30", site, "Hardness, Calc",
                        40.0 + i, "mg/L", None, 0.1, 0.2, None))
        if date not in dates:
            dates.add(date)
            final.append(("P", "A1", "Eden Creek", "mouth", "FDL", "Copper, Dissolved, ICP", "Metal",
                          "Copper, Dissolved", date, "wet weather" if storm else "Routine"))
    final += [("P", "B1", "Lyon Creek", "mouth", "Other 2", "Iron, Total, ICP", "Metal", "Iron, Total",
               final[0][8], final[0][9]),
              ("zdummy", "B1", "Ghost", "x", "FDL", "Ghost", "Metal", "Ghost", "1/1/99", "Routine")]
    raw.append((9999, "LAKES", "L0", "1/1/95 10:30", "A1", "Iron, Total, ICP", 1.0, "ug/L", None, 1.0, 2.0, None))
    raw_df = spark.createDataFrame(raw, schema.raw_layout(RAW))
    final_df = spark.createDataFrame(
        final, "PROJECT string, LOCATOR string, STREAM string, `POSITION ON STREAM` string, `Reporting Group` string, "
        "PARMNAME string, `GROUP 1` string, `GROUP 2` string, COLLECTDATE string, `SAMPLE TYPE (ROUTINE/STORM)` string")
    return raw_df, final_df, len(raw)


def test_raw_export_to_reports(spark):
    raw, final, size = export(spark)
    processed = plans.prepare_measurements(raw, final)
    rows = processed.collect()
    assert len(rows) == size - 1
    assert {r["stream"] for r in rows} == {"Eden Creek", "Lyon Creek C"}
    assert {r["year"] for r in rows} == set(range(1993, 1999))
    assert all(r["hardness"] is not None for r in rows)
    limits = plans.detection_limits(processed, ["sample"])
    assert limits.storm.filter("below_mdl AND rvqual IS NULL").count() == 0
    assert limits.storm.count() + limits.storm_hidden.count() == 120
    report = plans.criteria_report(limits.storm)
    rates = {r["parameter"]: r for r in report["rates"].collect()}
    assert set(rates) == {"Copper, Dissolved"} and rates["Copper, Dissolved"]["acute_n"] == 60
    assert report["over_aquatic"].count() > 0 and report["table_hardness"].count() == 1
    tests = plans.storm_against_base(limits)
    overall = {r["parameter"]: r for r in tests["overall"].collect()}
    assert all(r["mean_wet"] > r["mean_routine"] and r["sig"] for r in overall.values())
    assert tests["by_stream"].count() == 4 and tests["cells"].count() >= 1
    trends = plans.trend_report(limits.storm)
    assert trends["trends"].count() == 4 and trends["km"].count() == 4
    assert all(r["slope"] > 0 for r in trends["changes"].collect())
