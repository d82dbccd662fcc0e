"""Costly functions of columns whose values repeat, worked out once per value instead of once per row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialised

#: Distinct values, and bytes of them, that are held beside every task at most.
HELD_VALUES = 100_000
HELD_BYTES = 64 << 20


def few(df: DataFrame, keys: list[str]) -> int | None:
    """About how many distinct values of ``keys`` there are, or None if they may not fit in memory.

    A pass over these columns; no value is shuffled.
    """
    if df.isStreaming:
        return None
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys])
    seen = df.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("n"), F.coalesce(F.max(size), F.lit(0)).alias("size")).first()
    return seen.n if seen.n <= HELD_VALUES and seen.n * seen.size <= HELD_BYTES else None


def per_value(df: DataFrame, keys: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``derive(df)``, which adds columns that follow from ``keys`` alone.

    If the values of ``keys`` are few, each is worked out once, and rows meet what
    was found in a broadcast join; else every row is worked out where it is.
    """
    if few(df, keys) is None:
        return derive(df)
    return beside_values(df, keys, derive(df.select(*keys).distinct()))


def beside_values(df: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """``df`` with the columns that ``found``, a small table, has for each value of ``keys``; null is a value."""
    found = materialised(found, "values")
    new = [c for c in found.columns if c not in keys]
    own = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *new)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(F.broadcast(own), same, "left").select(*df.columns, *new)


def replaced(lists: Column, names: dict[str, str | None]) -> Column:
    """Lists of texts with each item replaced by its name; items without one are left out, a null list is empty."""
    def run(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        own = pa.array([names.get(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        kept = np.asarray(own.is_valid())
        ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)]))
        ends = np.concatenate([[0], np.cumsum(kept)])[ends.astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own.filter(pa.array(kept, pa.bool_())))

    # Marked so that the optimizer leaves it a column of its own.
    return F.arrow_udf(run, "array<string>").asNondeterministic()(lists)
