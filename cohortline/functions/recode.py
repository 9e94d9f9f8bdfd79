"""Codes, labels and flags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answers of the four-point scale, lowest agreement first.
LIKERT = {
    "strongly_disagree": 1,
    "somewhat_disagree": 2,
    "somewhat_agree": 3,
    "strongly_agree": 4,
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def any_of(*conditions: Column) -> Column:
    """OR over conditions where an unknown one counts as false."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def crosswalk(c: str | Column, codes: Mapping, default=None, keep_unmapped: bool = False) -> Column:
    """Code to code.  Unmapped values become ``default`` or, on request, stay as they are."""
    value = _col(c)
    out = None
    for old, new in codes.items():
        out = (F if out is None else out).when(value == F.lit(old), F.lit(new))
    if keep_unmapped:
        return out.otherwise(value)
    return out if default is None else out.otherwise(F.lit(default))


def keep_listed(c: str | Column, allowed: Iterable, default: str = "Missing") -> Column:
    """Whitelist: anything else, NULL included, becomes ``default``."""
    return F.when(_col(c).isin(*allowed), _col(c)).otherwise(F.lit(default))


def missing_if(c: str | Column, placeholders: Iterable[str], label: str = "Missing") -> Column:
    """Listed placeholders and NULL become ``label``."""
    return F.when(_col(c).isNull() | _col(c).isin(*placeholders), F.lit(label)).otherwise(_col(c))


def likert_code(c: str | Column, scale: Mapping[str, int] = LIKERT) -> Column:
    """Position on the agreement scale; unknown answers are NULL."""
    return crosswalk(c, scale)


def disagree_flag(code: str | Column, at_most: int = 2) -> Column:
    """1 when the code is on the disagreeing side.  A missing answer is not flagged."""
    return flag(_col(code) <= at_most)


def answer_is_yes(c: str | Column, no: str = "no") -> Column:
    """0 for 'no', 1 for any other answer; an absent answer stays NULL."""
    return F.when(_col(c).isNotNull(), F.when(_col(c) == no, 0).otherwise(1))


def rule_group(rules: Sequence[tuple[Column, str]], default: str = "Other") -> Column:
    """First matching rule wins; unknown conditions do not match."""
    out = None
    for condition, label in rules:
        out = (F if out is None else out).when(condition, F.lit(label))
    return out.otherwise(F.lit(default))


def one_hot(c: str | Column, values: Iterable) -> dict[str, Column]:
    """One 0/1 column per listed value, named after it (for ``withColumns``)."""
    return {str(v): flag(_col(c) == F.lit(v)) for v in values}
