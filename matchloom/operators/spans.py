"""Spells: resolved date spans, their union, and months attributed without double count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import dates as dt
from matchloom.functions.numeric import round_exact


def resolve_spans(
    entries: DataFrame, as_of: Column, start: str = "start_date", end: str = "end_date",
    current: str = "is_current", duration: str = "duration_months",
) -> DataFrame:
    """Adds start, end, months, is_open and the flags of each entry.

    A missing end is ``as_of``; an end before the start is clamped and flagged;
    the computed length always wins over the stated one.  ``start`` is null
    where the entry has no usable start date.
    """
    stated_end = F.col(end)
    start_on = dt.parse_date(F.col(start))
    end_on = dt.parse_date(stated_end)
    is_current = F.coalesce(F.col(current), F.lit(False))
    usable, ended = F.col("_s").isNotNull(), F.col("_e").isNotNull()
    until = F.coalesce(F.col("_e"), as_of)
    backwards = until < F.col("_s")
    unread_end = ~ended & (F.coalesce(stated_end, F.lit("")) != "")
    out = entries.withColumns({"_s": start_on, "_e": end_on}).select(
        *entries.columns,
        F.col("_s").alias("start_on"),
        F.when(usable, F.greatest(until, F.col("_s"))).alias("end_on"),
        (usable & (is_current | ~ended)).alias("is_open"),
        (~usable | unread_end | backwards).alias("bad_date"),
        (usable & ~ended & ~is_current).alias("open_ended"))
    months = dt.whole_months(F.col("start_on"), F.col("end_on"))
    return out.withColumns({
        "months": months,
        "off_length": F.coalesce(F.abs(F.col(duration) - months) > 2, F.lit(False))})


def interval_union(spans: DataFrame, by: str = "id") -> DataFrame:
    """Months covered by the union of an entity's spans.

    Only the latest end per start day matters, so rows are reduced to one per
    (entity, day) before the window; its partitions are bounded by the calendar.
    """
    days = spans.where(F.col("start_on").isNotNull()).groupBy(by, "start_on").agg(
        F.max("end_on").alias("end_on"))
    earlier = Window.partitionBy(by).orderBy("start_on").rowsBetween(
        Window.unboundedPreceding, -1)
    upto = Window.partitionBy(by).orderBy("start_on")
    islands = (
        days.withColumn("_reach", F.max("end_on").over(earlier))
        .withColumn("_new", F.when(F.col("start_on") <= F.col("_reach"), 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(upto))
        .groupBy(by, "_island")
        .agg(F.min("start_on").alias("start_on"), F.max("end_on").alias("end_on"))
    )
    return islands.groupBy(by).agg(
        F.sum(dt.whole_months(F.col("start_on"), F.col("end_on"))).cast("bigint")
        .alias("months_covered"),
        F.count(F.lit(1)).alias("islands"),
    )


#: A weight per item, made when it is needed, and the questions that ask for it.
Weight = tuple[Callable[[], np.ndarray], np.ndarray]


def _sums_before(first: np.ndarray, size: np.ndarray, height: np.ndarray, weigh: list[Weight],
                 ask: np.ndarray, reach: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For each question and weight: the sum over the last ``reach`` items of its entity of at most its height.

    Items stand entity by entity: ``first`` and ``size`` give an item's entity as
    its first item and number of items.  A question names its entity by its first
    item ``ask``.  Counted from an entity's end, the last ``reach`` items fall into
    blocks of a Fenwick tree, one for each bit of ``reach``; the items of a level's
    blocks are ordered by height, with running sums.
    """
    out = np.zeros((len(weigh), len(ask)), np.int64)
    from_end = first + size - 1 - np.arange(len(first))
    # Heights as ranks, so that (entity, block, height) is one number.
    ranks = np.unique(height)
    rank = np.searchsorted(ranks, height)
    bound = np.searchsorted(ranks, upto, "right")
    wide = len(ranks) + 1
    bit = 0
    while (reach >> bit).any():
        # Blocks of a level lie within their entity: its first item plus the block is unique there.
        items = np.flatnonzero(size >> bit)
        key = (first[items] + (from_end[items] >> bit)) * wide + rank[items] + 1
        by_key = np.argsort(key, kind="stable")
        key, items = key[by_key], items[by_key]
        block = (ask + (reach >> bit) - 1) * wide
        low, high = np.searchsorted(key, block, "right"), np.searchsorted(key, block + bound, "right")
        for k, (weight, only) in enumerate(weigh):
            asked = only[(reach[only] >> bit) & 1 == 1]
            if len(asked):
                running = np.concatenate([[0], np.cumsum(weight()[items])])
                out[k, asked] += running[high[asked]] - running[low[asked]]
        bit += 1
    return out


def _swept(entity: np.ndarray, start: np.ndarray, turn: np.ndarray, months: np.ndarray, count: np.ndarray,
           end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, months kept, months covered) of the longest spell of each start day.

    The months that the union of an entity's spells covers stand at its first
    item; other items have -1.

    Items are (entity, start day, months) with ``count`` spells, in order of entity
    and start, the one with the latest ``end`` first.  A later spell takes the
    smaller of its months and the whole months from its start to the end in
    question: the former if its last month turns (``turn``) by that end.  The rest
    is a difference of calendar months, less one where the day of the month of the
    start is the larger.
    """
    n = len(entity)
    new = np.ones(n, bool)
    new[1:] = entity[1:] != entity[:-1]
    heads = np.flatnonzero(new)
    own = np.cumsum(new) - 1
    first, size = heads[own], np.diff(np.append(heads, n))[own]
    days = new.copy()
    days[1:] |= start[1:] != start[:-1]
    asked = np.flatnonzero(days)
    past = first[asked] + size[asked]
    later = np.minimum(np.append(asked[1:], n), past)

    def calendar(day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        month = day.astype("datetime64[D]").astype("datetime64[M]")
        return month.astype(np.int64), day - month.astype("datetime64[D]").astype(np.int64)

    month, dom = calendar(start)
    until, until_dom = calendar(end[asked])
    every = np.arange(len(asked))
    # Months taken whole, spells and their start months; then spells that start after the end's day of the month.
    weigh: list[Weight] = [(lambda: count * months, every), (lambda: count, every), (lambda: count * month, every)]
    weigh += [(lambda d=d: count * (dom > d), np.flatnonzero(until_dom == d)) for d in range(31)]
    done = _sums_before(first, size, turn, weigh, first[asked], past - later, end[asked])
    # Items that start by the end in question, all of the entity's: a number for (entity, day).
    shift = int(min(start.min(), end.min()))
    span = int(max(start.max(), end.max())) - shift + 2
    started = np.searchsorted(first * span + start - shift, first[asked] * span + end[asked] - shift, "right")
    started = np.maximum(started, later)
    open_ = []
    for (weight, only), closed in zip(weigh, done):
        running = np.concatenate([[0], np.cumsum(weight())]) if len(only) else np.zeros(n + 1, np.int64)
        between = np.zeros(len(asked), np.int64)
        between[only] = running[started[only]] - running[later[only]] - closed[only]
        open_.append(between)
    lost = done[0] + until * open_[1] - open_[2] - sum(open_[3:])
    # An island begins where no earlier spell of the entity reaches; spells of a day end with the longest.
    reach = np.maximum.accumulate(first[asked] * span + end[asked] - shift)
    new_island = np.ones(len(asked), bool)
    new_island[1:] = first[asked][1:] * span + start[asked][1:] - shift > reach[:-1]
    begins = np.flatnonzero(new_island)
    ends = reach[np.append(begins[1:], len(asked)) - 1] % span + shift
    (from_month, from_dom), (to_month, to_dom) = calendar(start[asked[begins]]), calendar(ends)
    lengths = np.maximum(0, to_month - from_month - (to_dom < from_dom))
    heads_asked = np.flatnonzero(new[asked])
    covered = np.full(len(asked), -1, np.int64)
    covered[heads_asked] = np.add.reduceat(lengths, np.searchsorted(begins, heads_asked))
    return asked, np.maximum(0, months[asked] - lost), covered


#: Items that are swept together; a larger entity is swept alone, bounded by the calendar.
_SWEEP = 1 << 15


def attributed_months(spans: DataFrame, by: str = "id", ix: str = "ix", covered: bool = False) -> DataFrame:
    """(entity, entry, attributed): overlaps belong to the later-starting span.

    With ``covered`` one entry of each entity also has ``months_covered``, the
    months of :func:`interval_union`, for they fall out of the same sweep.

    The sum of pairwise overlaps with later spans is taken off, floored at 0;
    where two later spans overlap each other that part is taken off twice.  Of
    spans that start on one day only the longest (the first of those) keeps months.

    Spans are counted by (entity, start day, months) before they are dealt out, so
    what an entity brings is bounded by the calendar; entities are then swept in
    order, many at a time, with sums from a Fenwick tree over their start days.
    """
    return spans.where(F.col("start_on").isNotNull()).select(by, ix).join(
        longest_spells(spans, by, ix), F.col(by).eqNullSafe(F.col("_by")) & F.col(ix).eqNullSafe(F.col("_ix")), "left").select(
        by, ix, F.coalesce("attributed", F.lit(0)).cast("bigint").alias("attributed"),
        *([F.col("_covered").alias("months_covered")] if covered else []))


def longest_spells(spans: DataFrame, by: str = "id", ix: str = "ix") -> DataFrame:
    """``_by, _ix, attributed, _covered`` of the longest spell of each entity and start day: all that keep months."""
    usable = spans.where(F.col("start_on").isNotNull())
    items = usable.groupBy(by, "start_on", "months").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.unix_date("end_on")).alias("ne"), F.col(ix).alias("ix"))).alias("b"))
    rows = items.select(
        F.col(by).alias("by"), F.unix_date("start_on").cast("bigint").alias("start"),
        F.unix_date(dt.month_turn(F.col("start_on"), F.col("months"))).cast("bigint").alias("turn"),
        F.col("months").cast("bigint").alias("months"), "n", (-F.col("b.ne")).cast("bigint").alias("end"), F.col("b.ix").alias("ix"))
    rows = rows.repartition("by").sortWithinPartitions("by", "start", F.desc("end"), "ix")
    schema = rows.select(F.col("by").alias("_by"), F.col("ix").alias("_ix"), F.col("months").alias("attributed")).schema.add(
        "_covered", "long", True)

    def sweep(table: pa.Table, entity: np.ndarray) -> pa.RecordBatch:
        columns = [table.column(c).to_numpy() for c in ("start", "turn", "months", "n", "end")]
        at, kept, union = _swept(entity, *columns)
        at = pa.array(at)
        return pa.RecordBatch.from_arrays([table.column("by").take(at).combine_chunks(),
                                           table.column("ix").take(at).combine_chunks(), pa.array(kept),
                                           pa.array(union, mask=union < 0)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < _SWEEP:
                continue
            table = pa.Table.from_batches(held)
            entity = _runs(table.column("by"))
            # The last entity may go on in the next batch.
            whole = int(np.searchsorted(entity, entity[-1]))
            if whole:
                yield sweep(table.slice(0, whole), entity[:whole])
            held = table.slice(whole).to_batches()
            size -= whole
        if size:
            table = pa.Table.from_batches(held)
            yield sweep(table, _runs(table.column("by")))

    return rows.mapInArrow(run, schema)


def _runs(column: pa.ChunkedArray) -> np.ndarray:
    """A number per run of equal neighbours."""
    codes = column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.diff(codes, prepend=codes[:1]) != 0)


def tenure_columns(as_of: Column) -> dict[str, Column]:
    """Aggregates of :func:`tenure_stability`, for use in a wider ``agg``."""
    usable = F.col("start_on").isNotNull()
    return {
        "_avg_closed": F.avg(F.when(usable & ~F.col("is_open"), F.col("months"))),
        "_avg_all": F.avg(F.when(usable, F.col("months"))),
        "jobs_last_36m": F.count(F.when(
            usable & (dt.whole_months(F.col("start_on"), as_of) <= fv.RECENT_MONTHS), 1)),
    }


def tenure_band(avg: Column, recent: Column) -> Column:
    return (
        F.when((avg < fv.HOPPER_AVG) & (recent >= fv.HOPPER_STARTS), "hopper")
        .when(avg >= fv.STABLE_AVG, "stable")
        .otherwise("moderate")
    )


def tenure_stability(spans: DataFrame, as_of: Column, by: str = "id") -> DataFrame:
    """Mean length of closed spans (all, if none is closed), recent starts, and the band."""
    rolled = spans.groupBy(by).agg(*[c.alias(n) for n, c in tenure_columns(as_of).items()])
    avg = F.coalesce("_avg_closed", "_avg_all", F.lit(0.0))
    return rolled.select(
        by, round_exact(avg, 1).alias("avg_tenure_months"),
        F.col("jobs_last_36m").cast("bigint").alias("jobs_last_36m"),
        tenure_band(avg, F.col("jobs_last_36m")).alias("tenure_flag"),
    )


def current_spell(spans: DataFrame, by: str = "id", ix: str = "ix",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """Longest open span, first open entry, and the entry with the latest end."""
    usable = F.col("start_on").isNotNull()
    body = F.struct(F.col(ix).alias(ix), *[F.col(c) for c in carry])
    latest = F.struct((-F.unix_date("end_on")).alias("ne"), F.col(ix).alias("ix"))
    return spans.groupBy(by).agg(
        F.coalesce(F.max(F.when(usable & F.col("is_open"), F.col("months"))), F.lit(0))
        .cast("bigint").alias("current_months"),
        F.min_by(body, F.when(usable & F.col("is_open"), F.col(ix))).alias("current"),
        F.min_by(body, F.when(usable, latest)).alias("latest"),
    )


def snapshot_date(entries: DataFrame, fallback: Column, start: str, months: str,
                  is_current: str) -> DataFrame:
    """Upper median of start plus stated months over current entries."""
    implied = entries.where(F.col(is_current)).select(
        F.add_months(dt.parse_date(F.col(start)), F.col(months).cast("int")).alias("day"))
    # One row per calendar day from here on.
    days = implied.where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("_k"))
    everything = Window.partitionBy(F.lit(0))
    ranked = days.withColumn("_upto", F.sum("_k").over(everything.orderBy("day"))).withColumn(
        "_n", F.sum("_k").over(everything))
    # floor(n / 2) as a 0-based rank is the upper median.
    return ranked.where(F.col("_upto") > F.floor(F.col("_n") / 2)).agg(
        F.coalesce(F.min("day"), fallback).alias("snapshot_date"))


def feed_as_of(feed: DataFrame, observed: str, fallback: Column) -> DataFrame:
    return feed.agg(F.coalesce(F.max(dt.parse_date(F.col(observed))), fallback).alias("as_of"))
