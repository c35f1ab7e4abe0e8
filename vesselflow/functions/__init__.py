"""Column expressions (built-in Spark functions only, so they stay in codegen).

Each helper returns a ``Column``; none touches a DataFrame.  They encode the
analysis' value rules: how missing values count, how names are split, how
dates are built from parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesselflow import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- missing-value aware aggregates (T8, T9) ------------------------------------------------

def n_distinct(x) -> Column:
    """Distinct count where a missing value counts as one more value."""
    x = _c(x)
    return F.count_distinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))


def strict_sum(x) -> Column:
    """Sum that is missing as soon as one input is missing."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def strict_mean(x) -> Column:
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def ratio(num, den) -> Column:
    """num / den; missing when den is 0 (ANSI would raise)."""
    return F.try_divide(_c(num), _c(den))


def ieee_ratio(num, den) -> Column:
    """num / den with IEEE results for a zero denominator: +-Infinity or NaN."""
    num, den = _c(num), _c(den)
    return (F.when(den != 0, num / den)
            .when(num > 0, F.lit(float("inf")))
            .when(num < 0, F.lit(float("-inf")))
            .when(num == 0, F.lit(float("nan"))))


# --- text (F1-F4) --------------------------------------------------------------------------

def split_first(x, sep_regex: str = r"\(") -> tuple[Column, Column]:
    """Split at the first match into two fixed parts; second part '' when absent (F1)."""
    parts = F.split(_c(x), sep_regex, 2)
    return F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def trim_ws(x) -> Column:
    """Strip every leading/trailing whitespace character, not only blanks."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def detects(x, pattern: str) -> Column:
    """Regex detect; null input stays null."""
    return _c(x).rlike(pattern)


# --- dates (F5-F9, F16) --------------------------------------------------------------------

def month_start(year, month) -> Column:
    """First day of the month from parts."""
    return F.make_date(_c(year), _c(month), F.lit(1))


def safe_date(year, month, day) -> Column:
    """Date from parts; impossible dates (Feb 31) are missing instead of errors."""
    return F.try_to_date(F.concat_ws("-", _c(year).cast("string"), _c(month).cast("string"),
                                     _c(day).cast("string")), "yyyy-M-d")


def period_label(date, cut: str) -> Column:
    """'Before' strictly before the cut date, else 'After'; missing date stays missing."""
    d = _c(date)
    return F.when(d < F.to_date(F.lit(cut)), C.PERIOD_BEFORE).when(d.isNotNull(), C.PERIOD_AFTER)


def month_sequence(start, stop) -> Column:
    """All month starts from start to stop inclusive."""
    return F.sequence(_c(start), _c(stop), F.expr("interval 1 month"))


# --- numeric -------------------------------------------------------------------------------

def normalised_difference(a, b) -> Column:
    """(a - b) / (a + b), missing where a + b is 0."""
    a, b = _c(a), _c(b)
    return F.try_divide(a - b, a + b)


def id_text(x) -> Column:
    """Registration id as text without a trailing '.0' of a double."""
    s = _c(x).cast("string")
    return F.when(s.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(s, r"\.0+$", "")).otherwise(s)
