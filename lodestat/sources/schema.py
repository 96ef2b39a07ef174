"""Canonical column layouts of measurement tables."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT, DOUBLE, DATE, FLAG = (
    T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType(), T.BooleanType())


def layout(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


MEASUREMENT = layout(
    sample=TEXT, date=DATE, year=INT, month=INT, routine=TEXT, locator=TEXT, stream=TEXT,
    position=TEXT, loc_group=TEXT, metal_org=TEXT, parameter=TEXT, parmname=TEXT, value=DOUBLE,
    units=TEXT, qual=TEXT, mdl=DOUBLE, rdl=DOUBLE, textvalue=TEXT, hardness=DOUBLE)

REPLACED = layout(
    **{f.name: f.dataType for f in MEASUREMENT.fields},
    below_mdl=FLAG, replacement=DOUBLE, rvalue=DOUBLE, rvqual=TEXT)

KM_MEANS = layout(
    stream=TEXT, parameter=TEXT, mean=DOUBLE, median=DOUBLE, sd=DOUBLE, n=T.LongType(),
    n_censored=T.LongType(), all_censored=FLAG, log_mean=DOUBLE)

PARAMETER_LOOKUP = ("parmname", "metal_org", "parameter")

# Raw export column -> canonical column.
CANONICAL_NAMES = {
    "LABSAMPLENUM": "sample", "Date": "date", "Year": "year", "Month": "month",
    "Routine": "routine", "LOCATOR": "locator", "STREAM": "stream",
    "POSITION ON STREAM": "position", "Reporting Group": "loc_group", "GROUP 1": "metal_org",
    "GROUP 2": "parameter", "PARMNAME": "parmname", "NUMVALUE": "value", "UNITS": "units",
    "QUALIFIER": "qual", "MDL": "mdl", "RDL": "rdl", "TEXTVALUE": "textvalue",
}

# Numeric columns of the raw export; every other column is text.
RAW_NUMBERS = {
    "ROWID": INT, "TIMESPAN": DOUBLE, "SAMPLE_DEPTH": DOUBLE, "TOTAL_SOLIDS": DOUBLE,
    "NUMVALUE": DOUBLE, "MDL": DOUBLE, "RDL": DOUBLE, "YEAR": INT, "MONTH": INT, "DAY": INT,
}


def raw_layout(names) -> T.StructType:
    """Layout of a raw export: known numeric columns typed, the rest text."""
    return T.StructType([T.StructField(n, RAW_NUMBERS.get(n, TEXT), True) for n in names])
