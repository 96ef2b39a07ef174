"""Missing-value semantics of the source data's analysis language, as Column expressions.

A missing condition gives a missing result, membership is never missing, and later
conditions of a chain overwrite earlier ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def r_ifelse(condition: Column, yes, no) -> Column:
    """Conditional whose result is null where the condition is null."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def r_isin(column: Column, values) -> Column:
    """Membership in a literal list; a null value is simply not a member."""
    return F.coalesce(column.isin(list(values)), F.lit(False))


def r_not_isin(column: Column, values) -> Column:
    """Negated membership that keeps null values."""
    return ~r_isin(column, values)


def case_chain(pairs, default=None) -> Column:
    """Overwrite chain: start from ``default``; each (condition, value) overwrites the result.

    A null condition sets the result to null until a later condition decides again.
    """
    result = F.lit(default)
    for condition, value in pairs:
        result = r_ifelse(condition, value, result)
    return result


def any_condition(*conditions: Column) -> Column:
    """Three-valued OR over several predicates."""
    return reduce(lambda a, b: a | b, conditions)


def default_to(column: Column, default) -> Column:
    """Replace null by a default."""
    return F.coalesce(column, F.lit(default))


def fallback(*columns: Column) -> Column:
    """First value that is not missing."""
    return F.coalesce(*columns)


def clamp(column: Column, upper) -> Column:
    """Cap at an upper bound; a null stays null."""
    return F.when(column > F.lit(upper), F.lit(upper)).otherwise(column)


def count_distinct_with_null(column: Column) -> Column:
    """Number of distinct values where null counts as one value."""
    return F.count_distinct(column) + F.coalesce(F.max(column.isNull().cast("int")), F.lit(0))
