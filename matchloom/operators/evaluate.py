"""Ranking metrics per query, their uncertainty, and the costliest misses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions.numeric import round_exact
from matchloom.operators.skew import ranked, top_k
from matchloom.session import materialised


def graded_lists(ranking: DataFrame, labels: DataFrame, order: list[Column],
                 condensed: bool = True, query: str = "query", item: str = "item") -> DataFrame:
    """(query, item, rel, position): labelled items only, or unlabelled ones graded 0."""
    how = "inner" if condensed else "left"
    graded = ranking.join(labels.select(query, item, "rel"), [query, item], how)
    graded = graded.withColumn("rel", F.coalesce("rel", F.lit(0)))
    return ranked(graded, [query], order, "position")


def gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def discounted(rel: Column, position: Column) -> Column:
    return gain(rel) / F.log2(position + 1)


def dcg(rel: Column, position: Column, k: int) -> Column:
    """Aggregate: DCG over the first ``k`` positions, summed in position order."""
    terms = F.array_sort(F.collect_list(F.when(
        position <= k, F.struct(position.alias("p"), discounted(rel, position).alias("g")))))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["g"])


def ideal_dcg(lists: DataFrame, ks: list[int], query: list[str]) -> DataFrame:
    best = top_k(lists, query, [F.desc("rel")], max(ks), "_ideal")
    return best.groupBy(*query).agg(
        *[dcg(F.col("rel"), F.col("_ideal"), k).alias(f"ideal_{k}") for k in ks])


def ndcg(lists: DataFrame, ks: list[int], query: list[str]) -> DataFrame:
    """NDCG at each k per query; 0 where no item has any gain."""
    actual = lists.groupBy(*query).agg(
        *[dcg(F.col("rel"), F.col("position"), k).alias(f"dcg_{k}") for k in ks])
    both = actual.join(ideal_dcg(lists, ks, query), query)
    return both.select(*query, *[
        F.when(F.col(f"ideal_{k}") == 0, 0.0)
        .otherwise(F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_{k}") for k in ks])


def precision(k: int, threshold: int = fv.RELEVANT_GRADE) -> Column:
    hits = F.count(F.when((F.col("position") <= k) & (F.col("rel") >= threshold), 1))
    return hits / F.lit(k)


def reciprocal_rank(threshold: int = fv.RELEVANT_GRADE) -> Column:
    first = F.min(F.when(F.col("rel") >= threshold, F.col("position")))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def recall(k: int, threshold: int = fv.RELEVANT_GRADE) -> Column:
    relevant = F.count(F.when(F.col("rel") >= threshold, 1))
    hits = F.count(F.when((F.col("position") <= k) & (F.col("rel") >= threshold), 1))
    return F.when(relevant == 0, 0.0).otherwise(hits / relevant)


def precision_ceiling(relevant: Column, k: int = 5) -> Column:
    return F.least(relevant, F.lit(k)) / F.lit(k)


def query_metrics(lists: DataFrame, labels: DataFrame, query: str = "query",
                  digits: int = 4) -> DataFrame:
    """All metrics per query, rounded as reported."""
    counted = lists.groupBy(query).agg(
        F.count(F.lit(1)).alias("n_ranked"), precision(5).alias("precision_5"),
        reciprocal_rank().alias("mrr"), recall(10).alias("recall_10"))
    truth = labels.groupBy(query).agg(
        F.count(F.lit(1)).alias("n_labelled"),
        F.count(F.when(F.col("rel") >= fv.RELEVANT_GRADE, 1)).alias("n_relevant"))
    both = counted.join(truth, query).join(ndcg(lists, [5, 10], [query]), query)

    def shown(name: str) -> Column:
        return round_exact(F.col(name), digits).alias(name)

    return both.select(
        query, "n_ranked", "n_labelled", "n_relevant", shown("ndcg_10"), shown("ndcg_5"),
        shown("precision_5"), shown("mrr"), shown("recall_10"),
        round_exact(precision_ceiling(F.col("n_relevant")), digits).alias("precision_5_ceiling"))


def macro(per_query: DataFrame, metrics: list[str], by: list[str] | None = None,
          digits: int = 4) -> DataFrame:
    """Unweighted mean over queries; summed as integers so that order cannot matter."""
    def mean(m: str) -> Column:
        return F.sum(F.rint(F.col(m) * 1e9).cast("bigint")) / F.count(F.lit(1)) / 1e9

    rolled = per_query.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_queries"), *[mean(m).alias(m) for m in metrics])
    return rolled.select(*(by or []), "n_queries",
                         *[round_exact(F.col(m), digits).alias(m) for m in metrics])


def paired_positions(a: DataFrame, b: DataFrame, query: str = "query", item: str = "item") -> DataFrame:
    """Both positions and the grade of each labelled item."""
    right = b.select(query, item, F.col("position").alias("pos_b"))
    return a.select(query, item, "rel", F.col("position").alias("pos_a")).join(right, [query, item])


def portable_draw(seed: int, parts: list[Column], n: Column) -> Column:
    """Uniform draw in 0..n-1 from a digest; the same in any SQL engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint") % n


#: Places of an order that a resample is read to, and the items of an order that stand ready for them at first.
PLACES = 10
HEADS = 64
#: Items that are broadcast to the draws up to this number.
HELD_ITEMS = 200_000


def _draws(slots: DataFrame, resamples: int, seed: int, query: str) -> DataFrame:
    """The number of the item that each draw takes at each slot.

    The few items are dealt out before they are multiplied by the draws.  A number
    of tasks is asked for, as small partitions would else be joined to one.
    """
    tasks = int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = slots.repartition(tasks, query, "slot").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    return draws.withColumn("_no", portable_draw(seed, [F.col("draw"), F.col(query), F.col("slot")], F.col("_n")))


def _drawn_heads(items: DataFrame, slots: DataFrame, resamples: int, seed: int, query: str, heads: int) -> DataFrame:
    """How often each draw takes each of the first ``heads`` items of any order.

    Columns: query, draw, pos_a, pos_b, rel, in_a, in_b, in_i, times.  Draws of other items go no further than
    the task that makes them.
    """
    best = items
    for name, order in (("in_a", F.col("pos_a")), ("in_b", F.col("pos_b")), ("in_i", F.desc("rel"))):
        best = best.join(top_k(items.select(query, "_no", "pos_a", "pos_b", "rel"), [query], [order, F.col("_no")], heads, name)
                         .select(query, "_no", name), [query, "_no"], "left")
    best = materialised(best.where(F.coalesce("in_a", "in_b", "in_i").isNotNull()), "bootstrap-heads")
    draws = _draws(slots, resamples, seed, query)
    met = draws.select(query, "draw", "_no").join(
        best.hint("broadcast" if best.count() <= HELD_ITEMS else "merge"), [query, "_no"])
    flags = [F.col(c).isNotNull().alias(c) for c in ("in_a", "in_b", "in_i")]
    return met.select(query, "draw", "_no", "pos_a", "pos_b", "rel", *flags).groupBy(
        query, "draw", "_no", "pos_a", "pos_b", "rel", "in_a", "in_b", "in_i").agg(F.count(F.lit(1)).alias("times"))


def bootstrap_deltas(paired: DataFrame, resamples: int, order: list[Column],
                     seed: int = fv.BOOTSTRAP_SEED, query: str = "query", heads: int = HEADS) -> DataFrame:
    """(draw, delta): mean over queries of NDCG@10(b) - NDCG@10(a) on resampled items.

    Draws stay within a query.  Only the first ten places of a resample count, and
    they are nearly always filled by the first few dozen items of an order, so
    draws of other items are left out where they are made and what is shuffled
    follows queries x resamples.  Whether every resample has its ten places is
    checked; if one has not, more items are taken, up to all of them.
    """
    items = ranked(paired, [query], order, "_no").withColumn("_no", F.col("_no") - 1)
    items = materialised(items.select(query, "_no", "rel", "pos_a", "pos_b"), "bootstrap-items")
    sizes = items.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    facts = sizes.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")).first()
    slots = items.select(query, F.col("_no").alias("slot")).join(sizes, query)
    key = [query, "draw"]
    while True:
        drawn = materialised(_drawn_heads(items, slots, resamples, seed, query, heads), "bootstrap-draws")
        if heads >= facts["most"]:
            break
        filled = drawn.groupBy(*key).agg(*[F.sum(F.when(F.col(c), F.col("times")).otherwise(0)).alias(c)
                                           for c in ("in_a", "in_b", "in_i")]).join(sizes, query)
        whole = filled.where(F.least("in_a", "in_b", "in_i") >= F.least(F.lit(PLACES), F.col("_n"))).count()
        if whole == facts["queries"] * resamples:
            break
        heads *= 4
    by = Window.partitionBy(*key)
    parts = []
    for name, mine, at in (("a", "in_a", F.col("pos_a")), ("b", "in_b", F.col("pos_b")), ("i", "in_i", F.desc("rel"))):
        rows = drawn.where(mine)
        # At most 3 x heads items per draw.
        upto = F.sum("times").over(by.orderBy(at, "_no").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_upto", upto).where(F.col("_upto") - F.col("times") < PLACES)
        places = F.explode(F.sequence(F.col("_upto") - F.col("times") + 1, F.least(F.lit(PLACES), F.col("_upto"))))
        rows = rows.select(*key, "rel", places.alias("_place"))
        parts.append(rows.groupBy(*key).agg(dcg(F.col("rel"), F.col("_place"), PLACES).alias(f"dcg_{name}")))
    both = parts[0].join(parts[1], key).join(parts[2], key)
    delta = F.when(F.col("dcg_i") == 0, 0.0).otherwise(
        F.col("dcg_b") / F.col("dcg_i") - F.col("dcg_a") / F.col("dcg_i"))
    # Rounded per query so that the mean does not depend on the order of addition.
    rows = both.select(*key, F.rint(delta * 1e9).cast("bigint").alias("_d"))
    return rows.groupBy("draw").agg(
        (F.sum("_d") / F.count(F.lit(1)) / 1e9).alias("delta"))


def bootstrap_interval(deltas: DataFrame, resamples: int, digits: int = 4) -> DataFrame:
    """2.5 and 97.5 percent order statistics by index; one value per draw is collected."""
    low = int(fv.BOOTSTRAP_LOW * resamples)
    high = min(resamples - 1, int(fv.BOOTSTRAP_HIGH * resamples))
    return deltas.agg(F.array_sort(F.collect_list("delta")).alias("d")).select(
        round_exact(F.col("d")[low], digits).alias("low"),
        round_exact(F.col("d")[high], digits).alias("high"))


def _flip_sums(sizes: np.ndarray, times: np.ndarray, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over frequencies of the tail's Fourier terms; see :func:`sign_flip`."""
    total = int((sizes * times).sum())
    places = total + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = 0.0
        for batch in batches:
            k = batch.column("id").to_numpy()
            size = np.ones(len(k))
            for a, n in zip(sizes, times):
                # Whole turns are taken off as integers, so the angle keeps its precision.
                size *= np.cos(np.pi * ((k * a) % (2 * places)) / places) ** n
                live = np.abs(size) > 1e-18
                if not live.all():
                    k, size = k[live], size[live]
            phase = np.pi * ((k * total) % (2 * places)) / places - 2 * np.pi * ((k * at) % places) / places
            tail += float((size * np.exp(1j * phase) / (1 - np.exp(-2j * np.pi * k / places))).real.sum())
        yield pa.RecordBatch.from_arrays([pa.array([tail])], ["tail"])

    # exp(-i t at) / (1 - exp(-i t)) sums the terms from the observed place on, less the last one's, which is the same at t M = 2 pi k.
    return run


def sign_flip(deltas: DataFrame, delta: str, scale: int = 10_000) -> DataFrame:
    """Exact one-sided sign-flip test over the per-query deltas, however many there are.

    Deltas are taken as integers of 1/scale so that equality is exact, and counted
    by size; what reaches the driver is a row for each size, at most ``scale`` rows
    for deltas up to 1.  The flipped sum is a sum of independent steps on a lattice,
    so its tail is a finite Fourier sum with a product of cosines for each
    frequency.  Frequencies are dealt out over tasks; each holds the sizes only.
    With few queries the result is a count over 2^n patterns, and is taken to the
    nearest one.
    """
    spark = deltas.sparkSession
    units = deltas.select(F.rint(F.col(delta) * scale).cast("bigint").alias("d")).where("d is not null")
    rows = units.groupBy(F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("sum")).collect()
    rows = sorted(rows, key=lambda r: -r["size"])
    queries, observed = sum(r["n"] for r in rows), sum(r["sum"] for r in rows)
    sizes = np.array([r["size"] for r in rows if r["size"]], np.int64)
    times = np.array([r["n"] for r in rows if r["size"]], np.int64)
    total = int((sizes * times).sum())
    at = (observed + total) // 2
    p = (total - at + 1) / (total + 1)
    if total:
        half = total // 2 + 1
        sums = spark.range(1, half).mapInArrow(_flip_sums(sizes, times, at), "tail double").agg(F.sum("tail")).first()[0] or 0.0
        # Frequencies k and M - k are conjugate; the middle one of an even M stands alone.
        middle = 0.0
        if total % 2:
            middle = sum(b.column("tail")[0].as_py() for b in _flip_sums(sizes, times, at)(iter(
                [pa.RecordBatch.from_arrays([pa.array([half], pa.int64())], ["id"])])))
        p += (2 * sums + middle) / (total + 1)
    if queries <= 45:
        p = np.rint(p * 2.0 ** queries) / 2.0 ** queries
    out = spark.range(1).select(F.lit(queries).cast("bigint").alias("n"), F.lit(float(min(1.0, max(0.0, p)))).alias("p"),
                                F.lit(0.5 ** queries).alias("least"))
    return out.select(F.col("n").alias("n_queries"), round_exact(F.col("p"), 4).alias("p_one_sided"),
                      round_exact(F.col("least"), 4).alias("minimum_p"))


def verdict(per_query: DataFrame, delta: str, interval: DataFrame) -> DataFrame:
    """The mean delta, whether the interval holds zero, whether signs agree, and the direction."""
    d = F.col(delta)
    facts = per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        (F.bool_and(d > 0) | F.bool_and(d < 0)).alias("signs_agree"),
        (F.rint(F.sum(F.rint(d * 10_000).cast("bigint")) / F.count(F.lit(1))) / 10_000).alias("point"),
        F.avg(d).alias("_mean"))
    low = interval.select("low").scalar()
    high = interval.select("high").scalar()
    out = facts.withColumn("crosses_zero", (low <= 0) & (high >= 0))
    return out.select(
        "n_queries", "point", "crosses_zero", "signs_agree",
        F.when(F.col("_mean") > 0, "improvement").otherwise("regression").alias("direction"),
        F.concat(
            F.when(F.col("crosses_zero"), "the interval holds zero").otherwise(
                "the interval excludes zero"),
            F.lit("; signs "),
            F.when(F.col("signs_agree"), "agree").otherwise("do not agree")).alias("verdict"))


def worst_misses(lists: DataFrame, ideal_order: list[Column], limit: int, query: str = "query",
                 item: str = "item") -> DataFrame:
    """Items that give up the most discounted gain against their ideal place."""
    placed = ranked(lists, [query], ideal_order, "ideal_position")
    loss = gain(F.col("rel")) * (
        1.0 / F.log2(F.col("ideal_position") + 1) - 1.0 / F.log2(F.col("position") + 1))
    missed = placed.withColumn("loss", round_exact(loss, 4)).where(loss > 0)
    return missed.orderBy(F.desc("loss"), query, item).limit(limit)


def driving_component(breakdown: Column, maxima: dict[str, float]) -> Column:
    """The component furthest below its maximum, first declared on ties."""
    gaps = F.array(*[F.struct((-(F.lit(float(m)) - breakdown[n])).alias("neg"),
                              F.lit(i).alias("ord"), F.lit(n).alias("name"))
                     for i, (n, m) in enumerate(maxima.items())])
    return F.array_min(gaps)["name"]
