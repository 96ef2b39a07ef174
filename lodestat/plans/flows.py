"""Raw export to replaced measurements, criteria report, storm comparison and trends.

Each flow writes the tables that several later steps read (``stored``), as the analyses hand over
through files. Small results are returned lazily.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import add_year_month, parse_lab_date
from lodestat.operators import censor, compare, criteria, explore, prep, survival, trend
from lodestat.operators.relate import enrich, exclude
from lodestat.operators.reshape import group_mean
from lodestat.sources.files import stored

FIRST_YEAR, LAST_YEAR = 1993, 2010


def prepare_measurements(raw: DataFrame, final: DataFrame, extra: DataFrame | None = None,
                         bad: DataFrame | None = None, on_duplicate: str = "error") -> DataFrame:
    """Raw laboratory export and curated table to canonical measurements without bad rows.

    ``raw`` and ``final`` carry the export's column names; ``extra`` classifies parameters the
    curated table lacks.
    """
    raw = raw.filter(F.col("SITE") == "STREAMS").withColumn(
        "Date", parse_lab_date(F.col("COLLECTDATE")))
    final = final.filter(F.col("PROJECT") != "zdummy")
    # Lookups are read once and joined three times; their measured size decides the join.
    locator = stored(prep.location_lookup(final))
    parameter = stored(prep.parameter_lookup(final, extra))
    dates = stored(prep.date_lookup(final, parse_lab_date(F.col("COLLECTDATE"))))
    merged = enrich(raw, (locator, ["LOCATOR"]), (parameter, ["PARMNAME"]), (dates, ["Date"]))
    merged = add_year_month(merged, "Date").withColumnsRenamed({"year": "Year", "month": "Month"})
    streams = prep.to_canonical(merged.filter(F.col("Year").between(FIRST_YEAR, LAST_YEAR)))
    with_hardness = prep.derive_hardness(streams, on_duplicate)
    return exclude(with_hardness, bad if bad is not None else prep.bad_rows(raw.sparkSession))


@dataclass
class DetectionLimits:
    """Replaced measurements by event type, and the fully censored parameters set aside."""

    storm: DataFrame
    base: DataFrame
    storm_hidden: DataFrame
    base_hidden: DataFrame


def detection_limits(processed: DataFrame, row_order) -> DetectionLimits:
    """Flag, average replicates, split event types, replace non-detects limit by limit."""
    reps = stored(censor.average_replicates(
        censor.flag_censored(censor.drop_sparse_streams(processed)), row_order))
    parts = {}
    for name, routine in (("storm", compare.STORM), ("base", compare.BASE)):
        rows = censor.event_type(reps, routine)
        parts[name] = stored(censor.replace_nondetects(rows))
        parts[f"{name}_hidden"] = censor.split_all_nondetect(rows)[1]
    return DetectionLimits(**parts)


def criteria_report(replaced: DataFrame, table: DataFrame | None = None) -> dict[str, DataFrame]:
    """Exceedance lists, rates and the printed tables."""
    limits = criteria.criteria_table(replaced.sparkSession) if table is None else table
    judged = criteria.exceedance_ratios(criteria.attach_criteria(replaced, limits))
    rates = stored(criteria.exceedance_rates(judged))
    summary = stored(criteria.criteria_summary(judged))
    return {
        "over_aquatic": criteria.exceedances(judged, "aquatic"),
        "over_human": criteria.exceedances(judged, "human"),
        "rates": rates,
        "rates_by_stream": criteria.exceedance_rates(judged, ["parameter", "stream"]),
        "summary": summary,
        "table_fixed": criteria.report_table("fixed", criteria.fixed_criteria(judged)),
        "table_hardness": criteria.report_table("hardness", summary),
        "table_aquatic": criteria.report_table("aquatic", rates),
        "table_human": criteria.report_table("human", rates),
    }


def storm_against_base(limits: DetectionLimits) -> dict[str, DataFrame]:
    """Aligned comparison of the event types: overall tests, tests per stream, heatmap cells."""
    storm = limits.storm.unionByName(limits.storm_hidden, allowMissingColumns=True)
    base = limits.base.unionByName(limits.base_hidden, allowMissingColumns=True)
    both = stored(compare.prune_sparse(compare.align_domains(storm, base)))
    overall = stored(compare.gehan_test(both))
    level = compare.sidak_level(overall, F.col("mean_wet") > F.col("mean_routine"))
    overall = compare.flag_significant(overall, level)
    by_stream = stored(compare.ratio_classes(compare.gehan_by_stream(both, overall)))
    cells = explore.heatmap_cells(by_stream.filter("pseudosig"), value="log_ratio", method="none",
                                  label="storm_base_ratio", label_digits=2)
    return {"rows": both, "overall": overall, "by_stream": by_stream, "cells": cells}


def trend_report(replaced: DataFrame, alpha: float = 0.05) -> dict[str, DataFrame]:
    """Trends by parameter and stream, decadal changes with classes, heatmap cells, K-M table."""
    kept = trend.eligible(replaced, ["parameter", "stream"], "year", 3)
    trends = stored(trend.censored_trend(kept))
    changes = stored(trend.change_classes(trend.decadal_change(
        trend.significant_trends(trends, alpha), group_mean(replaced))))
    cells = explore.heatmap_cells(changes, value="log_change", method="none",
                                  label="decadal_change", reorder_x=False)
    return {"trends": trends, "changes": changes, "cells": cells,
            "km": survival.km_table(survival.km_summary(replaced))}
