"""Cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SUPPRESSED

# A text that does not parse costs an exception, many times what a number does. Nearly all such
# texts are known by a letter; the suppressed ones without a letter are tested one by one.
_LETTERLESS = [t for t in SUPPRESSED if t.upper() == t.lower()]


def number(c: str, dtype: str, suppressed=()) -> Column:
    """Text as a number: NULL for suppressed texts and for what does not parse.

    A blank counts as suppressed. Fractions are rounded to the scale of a decimal
    type; a fraction in an integer column, a value too wide, or a number with an
    exponent gives NULL. ``suppressed`` adds numerals that stand for a suppressed value.
    """
    texts = ", ".join(f"'{t.upper()}'" for t in [*_LETTERLESS, *suppressed])
    return F.expr(f"CASE WHEN upper({c}) = lower({c}) AND trim({c}) NOT IN ({texts}) THEN try_cast({c} AS {dtype}) END")


def us_date(c: str) -> Column:
    """MM/DD/YYYY (or ISO) text as a date, NULL when neither fits.

    Puts the three parts in ISO order and casts, which is several times cheaper than
    parsing by a pattern that fails on every other row.
    """
    t = f"trim({c})"
    iso = f"concat(substring_index({t}, '/', -1), '-', replace(substring_index({t}, '/', 2), '/', '-'))"
    three = f"length({t}) - length(replace({t}, '/', '')) = 2"
    return F.expr(f"try_cast(CASE WHEN {three} THEN {iso} WHEN length({t}) = 10 THEN {t} END AS DATE)")


def sentence_case(c: str) -> Column:
    """First letter of the whole text upper, all the rest lower."""
    return F.expr(f"concat(upper(substr(trim({c}), 1, 1)), lower(substr(trim({c}), 2)))")


def code(c: str) -> Column:
    return F.expr(f"upper(trim({c}))")


def yes_flag(c: str) -> Column:
    """True for any spelling of yes; everything else, NULL included, is False."""
    return F.expr(f"coalesce(upper(trim({c})) = 'YES', false)")


def not_blank(c: str) -> Column:
    return F.expr(f"trim({c}) != ''")


def ratio(top: str, bottom: str) -> Column:
    """Exact quotient, NULL where the divisor is zero."""
    return F.expr(f"CAST({top} AS DECIMAL(20,4)) / nullif({bottom}, 0)")


def percent(top: str, bottom: str, scale: int) -> Column:
    return F.expr(f"round(CAST({top} AS DECIMAL(20,4)) / nullif({bottom}, 0) * 100, {scale})")


def derived_rate(readmissions: str, discharges: str) -> Column:
    """Readmissions per hundred discharges at two places; NULL unless both are usable.

    Takes whole numbers and rounds half away from zero by whole-number division, which
    is exact and far cheaper per row than decimal division.
    """
    n, d = f"CAST({readmissions} AS BIGINT)", f"CAST({discharges} AS BIGINT)"
    hundredths = f"(20000 * {n} + CASE WHEN {n} < 0 THEN -{d} ELSE {d} END) div (2 * {d})"
    return F.expr(
        f"CASE WHEN {discharges} > 0"
        f" THEN try_cast(CAST({hundredths} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(8,4)) END"
    )
