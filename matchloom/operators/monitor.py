"""Store health, distributions, reach, drift alarms and cost, each as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions.numeric import round_exact
from matchloom.operators.skew import selected_values


def store_health(signals: DataFrame, version: str) -> DataFrame:
    current = F.count(F.when(F.col("signals_version") == version, 1))
    rolled = signals.agg(F.count(F.lit(1)).alias("rows_total"), current.alias("rows_current"))
    status = (
        F.when(F.col("rows_total") == 0, "empty")
        .when(F.col("rows_current") < F.col("rows_total"), "stale_versions").otherwise("ok")
    )
    return rolled.select("rows_total", "rows_current", status.alias("status"))


def distribution(df: DataFrame, dims: list[str], confidence: str) -> DataFrame:
    """Counts per value of each dimension, and over all, in one grouping-sets pass."""
    # One row per (input row, dimension) would multiply the shuffle; a single
    # expand feeds a hash aggregate with map-side combine instead.
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level"))
                      for d in dims],
                    F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("level")))
    rows = df.select(F.explode(parts).alias("_p"), F.col(confidence).alias("_c"))
    return rows.groupBy(F.col("_p.dimension").alias("dimension"),
                        F.col("_p.level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("_c") < fv.LOW_CONFIDENCE, 1)).alias("low_confidence"),
        F.min("_c").alias("min_confidence"), F.max("_c").alias("max_confidence"))


def feed_reach(events: DataFrame) -> DataFrame:
    """Events, entities touched and recomputed, and share of events per materiality."""
    per = events.groupBy("materiality", "entity").agg(
        F.count(F.lit(1)).alias("_n"), F.max("signals_recomputed").alias("_r"))
    rolled = per.groupBy("materiality").agg(
        F.sum("_n").alias("events"), F.count(F.lit(1)).alias("entities"),
        F.count(F.when(F.col("_r"), 1)).alias("recomputed"))
    # The window runs over the closed list of materialities.
    whole = F.sum("events").over(Window.partitionBy(F.lit(0)))
    return rolled.select("materiality", "events", "entities", "recomputed",
                         round_exact(F.col("events") / whole, 4).alias("share"))


def class_share_alarms(df: DataFrame, period: str, cls: str, min_history: int = 3,
                       sd: float = fv.ALARM_CLASS_SD) -> DataFrame:
    """Class share per period against mean and deviation of the periods before it."""
    counted = df.groupBy(period, cls).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(period).agg(F.sum("n").alias("total"))
    shares = counted.join(totals, period).withColumn("share", F.col("n") / F.col("total"))
    # One row per (period, class); history is bounded by the calendar.
    past = Window.partitionBy(cls).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    out = (
        shares.withColumn("_k", F.count(F.lit(1)).over(past))
        .withColumn("mean", F.avg("share").over(past))
        .withColumn("dev", F.stddev("share").over(past))
    )
    alarm = (F.col("_k") >= min_history) & (F.abs(F.col("share") - F.col("mean"))
                                            > F.col("dev") * sd)
    return out.select(period, cls, "n", round_exact(F.col("share"), 6).alias("share"),
                      F.coalesce(alarm, F.lit(False)).alias("alarm"))


def rate_alarms(df: DataFrame, period: str, rates: dict[str, tuple[Column, str, float]]) -> DataFrame:
    """One row per (period, rule): the rate and whether it crosses its limit.

    ``rates`` maps a rule name to (condition, 'above' or 'below', limit).
    """
    rolled = df.groupBy(period).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(cond, 1)).alias(f"_r_{name}") for name, (cond, _, _) in rates.items()])
    parts = []
    for name, (_, side, limit) in rates.items():
        rate = F.col(f"_r_{name}") / F.col("_n")
        parts.append(F.struct(
            F.lit(name).alias("rule"), round_exact(rate, 6).alias("rate"),
            (rate > limit if side == "above" else rate < limit).alias("alarm")))
    return rolled.select(period, F.explode(F.array(*parts)).alias("_a")).select(period, "_a.*")


def mean_drop_alarms(df: DataFrame, period: str, value: Column,
                     drop: float = fv.ALARM_CONFIDENCE_DROP) -> DataFrame:
    """Mean per period and whether it fell by more than ``drop`` since the period before."""
    means = df.groupBy(period).agg(F.avg(value).alias("_m"))
    # One row per period: bounded by the calendar.
    before = F.lag("_m").over(Window.partitionBy(F.lit(0)).orderBy(period))
    return means.select(period, round_exact(F.col("_m"), 6).alias("mean"),
                        F.coalesce(before - F.col("_m") > drop, F.lit(False)).alias("alarm"))


def percentile_alarms(df: DataFrame, period: str, value: str, limit: float = fv.ALARM_P95_MS) -> DataFrame:
    """The 95th percentile per period, by index as for latencies, and whether it is over the limit."""
    n = F.col("n")
    found = selected_values(df, value, {"p95": F.least(n - 1, F.floor(n * 0.95))}, [period])
    return found.select(period, F.lit("p95").alias("rule"), round_exact(F.col(value), 6).alias("rate"),
                        (F.col(value) > limit).alias("alarm"))


def skill_totals(signals: DataFrame) -> DataFrame:
    """How many skills are shown by work and how many are only claimed, and in how many rows."""
    shown, claimed = F.size("core_skills"), F.size("claimed_skills_unverified")
    return signals.agg(
        F.sum(shown).alias("evidenced"), F.sum(claimed).alias("claimed"),
        F.count(F.when(shown > 0, 1)).alias("rows_evidenced"), F.count(F.when(claimed > 0, 1)).alias("rows_claimed"))


def observed(df: DataFrame, stage: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counters that fill while any later action runs: no second pass for telemetry."""
    observation = Observation(stage)
    return df.observe(observation, F.count(F.lit(1)).alias("rows_out"), *[c.alias(n) for n, c in counters.items()]), observation


def cost_projection(df: DataFrame, stage: str, seconds: Column, rows: Column,
                    memory_gb: float = 2.0, million: int = 1_000_000) -> DataFrame:
    """Milliseconds per row, and CPU hours and dollars per million rows, per stage."""
    rolled = df.groupBy(stage).agg(F.sum(seconds).alias("_s"), F.sum(rows).alias("rows"))
    per_row = F.col("_s") / F.col("rows")
    hours = per_row * million / 3600.0
    return rolled.select(
        stage, F.col("rows").cast("bigint").alias("rows"),
        round_exact(per_row * 1000, 4).alias("ms_per_row"),
        round_exact(hours, 4).alias("cpu_hours_per_million"),
        round_exact(hours * (fv.PRICE_VCPU_HOUR + memory_gb * fv.PRICE_GB_HOUR), 4)
        .alias("dollars_per_million"))


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * fv.PRICE_MTOK_IN + tokens_out / 1e6 * fv.PRICE_MTOK_OUT


def arm_summary(df: DataFrame, arm: str, truth: Column, predicted: Column, valid: Column) -> DataFrame:
    """Validity, accuracy and the distinct confusions of each arm."""
    right = F.coalesce(predicted == truth, F.lit(False))
    pairs = df.groupBy(arm, truth.alias("_t"), predicted.cast("string").alias("_p"),
                       right.alias("_ok"), valid.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    confusion = F.when(~F.col("_ok"), F.concat(
        F.col("_t").cast("string"), F.lit(" -> "), F.coalesce("_p", F.lit("none"))))
    return pairs.groupBy(arm).agg(
        F.sum("_n").alias("n"), F.sum(F.when(F.col("_v"), F.col("_n")).otherwise(0)).alias("valid"),
        F.sum(F.when(F.col("_ok"), F.col("_n")).otherwise(0)).alias("correct"),
        F.array_join(F.array_sort(F.collect_set(confusion)), "; ").alias("confusions")
    ).select(arm, "n", "valid", "correct",
             round_exact(F.col("correct") / F.col("n"), 4).alias("accuracy"), "confusions")
