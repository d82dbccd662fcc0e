"""Dates and whole-month arithmetic.  ``as_of`` is always given, never read from a clock."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions.numeric import let

# ---------------------------------------------------------------- fixed values
# Accepted shapes and the Spark pattern that reads each.
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{4}-\d{1,2}$", "y-M"),
    (r"^\d{4}$", "y"),
]
# Ages in months (200 years) whose decay is tabulated.
DECAY_MONTHS = 2_400
# ------------------------------------------------------------ end fixed values


def parse_date(text: Column) -> Column:
    """DATE from five text shapes; anything else is null."""
    def read(head: Column) -> Column:
        return F.coalesce(*[
            F.try_to_date(F.when(head.rlike(shape), head), pattern)
            for shape, pattern in DATE_SHAPES])

    return let(F.regexp_extract(F.trim(text), r"^([^T]*)", 1), read)


def whole_months(start: Column, end: Column) -> Column:
    """Complete months from ``start`` to ``end``, never below 0."""
    raw = (
        (F.year(end) - F.year(start)) * 12
        + F.month(end) - F.month(start)
        - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)
    )
    return F.greatest(F.lit(0), raw)


def month_turn(start: Column, k: Column) -> Column:
    """First date on which ``whole_months(start, date)`` reaches ``k``."""
    moved = F.add_months(start, k)
    short = F.dayofmonth(moved) < F.dayofmonth(start)
    return F.when(short, F.date_add(moved, 1)).otherwise(moved)


def entry_age(end: Column, is_open: Column, as_of: Column) -> Column:
    return F.when(is_open | (end >= as_of), 0).otherwise(whole_months(end, as_of))


def decay(age: Column, half_life: float = fv.HALF_LIFE_MONTHS) -> Column:
    """One half to the power of ``age / half_life``.

    The power of the JVM is off by one unit in the last place for some ages, so
    that scores which are equal, or fall in a known order, changed places.  Whole
    ages are read from a table made with the power of the C library, which SQL
    engines use; any other age is computed.
    """
    if half_life <= 0:
        return F.lit(1.0)
    table = F.from_json(F.lit(json.dumps([math.pow(0.5, a / half_life) for a in range(DECAY_MONTHS)])), "array<double>")
    whole = age.cast("int")
    return F.when((age == whole) & (whole >= 0) & (whole < DECAY_MONTHS), F.get(table, whole)).otherwise(
        F.pow(F.lit(0.5), age / F.lit(half_life)))
