"""Number-to-text and text-shaping column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed


def fill(template: str, **values: Column) -> Column:
    """A string column: ``template`` with its ``{name}`` places taken from ``values``."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def fixed_one(x: Column) -> Column:
    """One decimal, nearest to the exact binary value and upwards at a tie, for x >= 0.

    The tie above ``k`` tenths lies at (2k+1)/20. The sign of 20x - (2k+1) decides,
    and taken as (16x - (2k+1)) + 4x it loses nothing near the tie: the powers of
    two are exact and so are both sums there.
    """
    tenths = F.floor(x * 10.0)
    beyond_tie = (x * 16.0 - (tenths * 2 + 1)) + x * 4.0 >= 0
    rounded = tenths + beyond_tie.cast("int")
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def fixed_zero(x: Column) -> Column:
    """No decimals, upwards at a tie, for x >= 0."""
    whole = F.floor(x)
    return (whole + (x - whole >= 0.5).cast("int")).cast("string")


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as a double, 0 where ``whole`` is 0."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def rate_text(part: Column, whole: Column) -> Column:
    """A rate as report text: one decimal, or ``'0'`` when there is nothing to divide by."""
    return F.when(whole > 0, fixed_one(part / whole * 100.0)).otherwise(F.lit("0"))


def rate_number(rate: Column) -> Column:
    """The number a rate text stands for; missing or empty counts as 0."""
    return F.coalesce(F.nullif(rate, F.lit("")).try_cast("double"), F.lit(0.0))


def rate_short(rate: Column) -> Column:
    """A rate text as a bare number prints: ``50.0`` becomes ``50``."""
    return F.regexp_replace(F.coalesce(F.nullif(rate, F.lit("")), F.lit("0")), r"\.0$", "")


def or_not_available(value: Column) -> Column:
    """Counts of 0 and missing values print ``N/A``. Rates are texts, so '0' stays."""
    text = value.cast("string")
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(fixed.NOT_AVAILABLE)).otherwise(text)


def or_text(value: Column, default: str) -> Column:
    """``value``, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default))


def strip_fences(content: Column) -> Column:
    """Drop Markdown code fences around a model answer, and the white space at its ends."""
    opened = F.regexp_replace(content, r"(?i)```json\s*", "")
    bare = F.regexp_replace(opened, r"```\s*", "")
    return F.regexp_replace(bare, r"\A\s+|\s+\z", "")


def lines(items: Column, template: str, **fields: str) -> Column:
    """One line per array element: ``template`` filled from the element's named fields."""

    def line(item: Column) -> Column:
        return fill(template, **{name: item[field] for name, field in fields.items()})

    return F.array_join(F.transform(items, line), "\n")
