"""Column functions: pure expressions, no shuffles."""

from cohortline.functions.dates import (
    bin_days,
    closed_before,
    days_between,
    in_year,
    local_date,
    month_end,
    period_keys,
    week_ending,
    week_start,
)
from cohortline.functions.recode import (
    any_of,
    answer_is_yes,
    crosswalk,
    disagree_flag,
    flag,
    keep_listed,
    likert_code,
    missing_if,
    one_hot,
    rule_group,
)
from cohortline.functions.text import blank_to_null, fill_missing, list_items, normalize_text

__all__ = [
    "any_of", "answer_is_yes", "bin_days", "blank_to_null", "closed_before", "crosswalk",
    "days_between", "disagree_flag", "fill_missing", "flag", "in_year", "keep_listed",
    "likert_code", "list_items", "local_date", "missing_if", "month_end", "normalize_text",
    "one_hot", "period_keys", "rule_group", "week_ending", "week_start",
]
