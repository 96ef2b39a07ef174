"""Column expressions: null semantics, text, dates, safe math, normal and t distributions."""

from lodestat.functions.nulls import (
    any_condition,
    case_chain,
    clamp,
    count_distinct_with_null,
    default_to,
    fallback,
    r_ifelse,
    r_isin,
    r_not_isin,
)
from lodestat.functions.numbers import (
    lognorm_quantile,
    norm_cdf,
    norm_quantile,
    numeric_grid,
    ratio,
    round_half_even,
    safe_ln,
    safe_log10,
    t_quantile,
)
from lodestat.functions.text import (
    add_year_month,
    detect,
    first_word,
    parse_lab_date,
    paste,
    shift_months,
    str_sub,
    stream_label,
)

__all__ = [
    "add_year_month", "any_condition", "case_chain", "clamp", "count_distinct_with_null",
    "default_to", "detect", "fallback", "first_word", "lognorm_quantile", "norm_cdf",
    "norm_quantile", "numeric_grid", "parse_lab_date", "paste", "r_ifelse", "r_isin",
    "r_not_isin", "ratio", "round_half_even", "safe_ln", "safe_log10", "shift_months",
    "str_sub", "stream_label", "t_quantile",
]
