"""Text and date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.nulls import r_ifelse

# Date layouts of the laboratory exports.
DATE_FORMATS = ("M/d/yy", "M/d/yyyy")
DATE_TIME_FORMATS = ("M/d/yy H:mm", "M/d/yyyy H:mm")


def detect(column: Column, pattern: str, literal: bool = False) -> Column:
    """True where the text matches the pattern; null text gives null."""
    return F.contains(column, F.lit(pattern)) if literal else column.rlike(pattern)


def first_word(column: Column) -> Column:
    """First run of word characters (Unicode aware), null when there is none."""
    return F.nullif(F.regexp_extract(column, r"(?U)\w+", 0), F.lit(""))


def str_sub(column: Column, start: int, end: int) -> Column:
    """Inclusive substring; negative positions count from the end."""
    if (start < 0) == (end < 0):
        return F.substring(column, start, end - start + 1)
    if start > 0:
        return F.substring(column, F.lit(start), F.length(column) + F.lit(end + 2 - start))
    raise ValueError("a start counted from the end needs an end counted from the end")


def paste(*columns, sep: str = "") -> Column:
    """Concatenate; a null part makes the whole null."""
    parts: list[Column] = []
    for column in columns:
        if parts and sep:
            parts.append(F.lit(sep))
        parts.append(column)
    return F.concat(*parts)


def parse_lab_date(column: Column, formats=DATE_FORMATS + DATE_TIME_FORMATS) -> Column:
    """Parse month-first dates in any of the formats; two-digit years 69-99 mean 19xx."""
    parsed = []
    for fmt in formats:
        day = F.to_date(F.try_to_timestamp(F.trim(column), F.lit(fmt)))
        if "yyyy" not in fmt:
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        parsed.append(day)
    return F.coalesce(*parsed)


def add_year_month(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"year": F.year(date), "month": F.month(date)})


def shift_months(column: Column, months: int) -> Column:
    """Move a date by whole months, clamped to the last day of the target month."""
    return F.add_months(column, months)


def stream_label(stream: Column) -> Column:
    """Two-letter label; 'Pipers' streams are 'Pp'; a trailing B or C is kept."""
    last = str_sub(stream, -1, -1)
    base = r_ifelse(detect(stream, "Pipers", literal=True), F.lit("Pp"), str_sub(stream, 1, 2))
    return F.when(F.coalesce(last.isin("B", "C"), F.lit(False)), F.concat(base, last)).otherwise(base)
