"""Tolerant coercion of loosely typed text; nothing here raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
TRUE_WORDS = ["true", "yes", "y", "1"]
FALSE_WORDS = ["false", "no", "n", "0"]
# ------------------------------------------------------------ end fixed values


def to_int(text: Column) -> Column:
    """Integer from text with thousands commas, truncated; JSON booleans are null."""
    number = F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), number).cast("bigint")


def to_bool(text: Column) -> Column:
    word = F.lower(F.trim(text))
    number = word.try_cast("double")
    return (
        F.when(word.isin(TRUE_WORDS), True)
        .when(word.isin(FALSE_WORDS), False)
        .when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), number != 0)
    )


def to_text_list(items: Column) -> Column:
    """Drops null and blank items; a null list is empty."""
    kept = F.filter(items, lambda item: item.isNotNull() & (F.trim(item) != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def text_or_list(raw: Column) -> Column:
    """List from raw JSON text: an array as it is, a bare string as one item."""
    as_list = F.from_json(raw, "array<string>")
    return (
        F.when(raw.startswith("["), to_text_list(as_list))
        .when(raw.isNull() | raw.startswith("{"), F.array().cast("array<string>"))
        .otherwise(F.array(raw))
    )
