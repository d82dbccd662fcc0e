"""Rounding that agrees with correctly rounded decimal rounding of a double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float(2**27 + 1)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` written once.

    Catalyst substitutes an alias for each of its uses when it moves filters
    down, so an expression that repeats its operand would grow with every level
    of nesting; a bound variable does not.
    """
    return F.element_at(F.transform(F.array(x), body), 1)


def round_exact(x: Column, digits: int) -> Column:
    """Round half to even on the exact binary value of ``x``.

    The builtin ``round`` works on the shortest decimal text, so 1.005 becomes
    1.01 although the double lies below 1.005.  Here the error of ``x * 10^d``
    is recovered exactly (Veltkamp split), so a seeming tie is only treated as
    one when it truly is.
    """
    scale = float(10**digits)

    def rounded(v: Column) -> Column:
        scaled = v * scale
        high = v * _SPLIT - (v * _SPLIT - v)
        error = (high * scale - scaled) + (v - high) * scale
        low = F.floor(scaled)
        tie = (scaled - low) == 0.5
        picked = (
            F.when(tie & (error > 0), low + 1)
            .when(tie & (error < 0), low)
            .otherwise(F.rint(scaled))
        )
        return picked.cast("double") / scale

    return let(x.cast("double"), rounded)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
