"""Helpers that keep a hot key from becoming one task.

Each replaces a construct that would gather a whole group: a window over an
unbounded partition, a collected list, or a rank over all rows of one group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import materialised

def in_blocks(small: DataFrame, item: Column, rows: int = 256) -> tuple[DataFrame, int]:
    """A table beside which every row of another one is to stand, cut into arrays.

    Gives ``(_block, _items)`` with about ``rows`` items each, and the number of
    blocks; no item is left out, however many there are.
    """
    blocks = max(1, -(-small.count() // rows))
    place = F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")
    return small.groupBy(place.alias("_block")).agg(F.collect_list(item).alias("_items")), blocks


def beside_blocks(df: DataFrame, small: DataFrame, blocks: int, salts: int = 64) -> DataFrame:
    """Each row of ``df`` with each block: an equi-join on block and a salt of the row.

    The blocks are copied to every salt, so the rows of ``df`` spread over
    blocks x salts tasks wherever the blocks are too large to broadcast.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    left = df.withColumn("_salt", salt).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["_block", "_salt"]).drop("_block", "_salt")


def in_ranges(df: DataFrame, keys: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` sorted by ``keys``, written in ranges of about equal size, with its place.

    The splitters come from a sample of the full key, so keys of any type and with
    any common prefix fall apart, and a number per row breaks ties, so equal keys
    do too.  ``_range`` is the range and ``_at`` the number within it; both grow
    with the key.  There are as many ranges as shuffle partitions, or ``parts``.
    The input is read twice, for the sample and for the rows: write it first where
    it is costly.
    """
    keys = [*keys, F.col("_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    # Numbered by partition and row: the order in which the sort hands the rows on.
    placed = rows.sortWithinPartitions(*keys).drop("_tie").withColumn("_place", F.monotonically_increasing_id())
    out = materialised(placed, "ranges")
    return out.select(*df.columns, F.shiftright("_place", 33).cast("int").alias("_range"),
                      F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank",
           parts: int | None = None) -> DataFrame:
    """Row number within ``group`` by ``order``, without gathering the rows of a group.

    Rows are dealt into ranges of (group, order) and sorted there.  A group's rows
    are then a run of each range that they reach, so a rank is the place in that
    run plus the sizes of the group's earlier runs.  The only window goes over
    those sizes: groups and ranges together bound their number.
    """
    placed = in_ranges(df, [F.col(g) for g in group] + order, parts)
    runs = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_range").alias("_r"),
                       (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(runs, same).select(*df.columns, (F.col("_off") + F.col("_at")).cast("bigint").alias(name))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int,
          name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark cuts every map task to ``k`` rows per group first."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("bigint")).where(F.col(name) <= k)


def carry_last(
    df: DataFrame, key: list[str], bucket: Column, order: list[str], keep: Column,
    values: dict[str, Column],
) -> DataFrame:
    """Adds, per row, the ``values`` of the last earlier row of its key where ``keep``.

    ``bucket`` must be monotone in ``order`` (a calendar hour, say).  The window
    runs inside a (key, bucket) cell; the last kept row of all earlier buckets
    comes from a table of one row per cell, so a key with most of the rows is
    spread over its buckets.
    """
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    rows = df.withColumn("_bucket", bucket).withColumn("_kept", F.when(keep, packed))
    at = F.struct(*[F.col(c) for c in order])
    cells = rows.groupBy(*key, "_bucket").agg(
        F.max_by("_kept", F.when(F.col("_kept").isNotNull(), at)).alias("_last"))
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = cells.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop(
        "_last")
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    out = rows.withColumn("_near", F.last("_kept", ignorenulls=True).over(inside))
    out = out.join(carried, key + ["_bucket"], "left")
    found = F.coalesce(F.col("_near"), F.col("_carried"))
    return out.select(*df.columns, *[found[n].alias(n) for n in values])


def selected_values(
    df: DataFrame, value: str, picks: dict[str, Column], by: list[str] | None = None
) -> DataFrame:
    """Exact order statistics: for each pick the value at that 0-based rank.

    ``picks`` maps a name to a rank expression over the column ``n`` (row
    count).  Ranks are located in a coarse histogram first, counted map-side from
    the rows, then in a fine one inside the located bin, and only the distinct
    values of that fine bin are ordered; no step gathers more than the bins.
    """
    by = by or []
    v = F.col(value).cast("double")
    # Coarse bins are logarithmic (at most about 1.5 million); fine ones split a bin evenly.
    coarse = (F.signum(v) * F.floor(F.log1p(F.abs(v)) * 1000)).cast("bigint")
    rows = df.where(v.isNotNull()).select(*by, v.alias("_v"), coarse.alias("_c"))
    cells = rows.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_up"))
    total = cells.groupBy(*by).agg(F.sum("_k").alias("n"))
    wanted = total.select(*by, F.explode(F.array(*[
        F.struct(F.lit(name).alias("pick"), rank.cast("bigint").alias("at"))
        for name, rank in picks.items()])).alias("_p")).select(*by, "_p.pick", "_p.at")

    def locate(cells: DataFrame, wanted: DataFrame, cell: str, within: list[str]) -> DataFrame:
        upto = Window.partitionBy(*within).orderBy(cell)
        edges = cells.withColumn("_hi", F.sum("_k").over(upto))
        return (
            wanted.join(edges, within)
            .where((F.col("at") >= F.col("_hi") - F.col("_k")) & (F.col("at") < F.col("_hi")))
            .withColumn("at", F.col("at") - (F.col("_hi") - F.col("_k")))
            .drop("_hi", "_k")
        )

    # A constant group column keeps the window partitioned when the caller has none.
    if not by:
        rows, cells = rows.withColumn("_all", F.lit(0)), cells.withColumn("_all", F.lit(0))
        wanted = wanted.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    first = locate(cells, wanted, "_c", keys)
    width = F.greatest(F.col("_up") - F.col("_lo"), F.lit(1e-300))
    fine = F.floor((F.col("_v") - F.col("_lo")) / width * 65536).cast("bigint")
    # From here on only rows of the located bins count.
    inside = rows.join(first, keys + ["_c"]).withColumn("_f", fine)
    second = locate(
        inside.groupBy(*keys, "pick", "_f").agg(F.count(F.lit(1)).alias("_k")),
        first.select(*keys, "pick", "at"), "_f", keys + ["pick"])
    last = locate(
        inside.drop("at").join(second.drop("at"), keys + ["pick", "_f"])
        .groupBy(*keys, "pick", "_v").agg(F.count(F.lit(1)).alias("_k")),
        second.select(*keys, "pick", "at"), "_v", keys + ["pick"])
    return last.select(*by, "pick", F.col("_v").alias(value))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
