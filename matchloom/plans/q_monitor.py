"""Queries over monitoring aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions.numeric import round_exact
from matchloom.operators import monitor as mon
from matchloom.operators.skew import selected_values, union_all
from matchloom.operators import evaluate as ev
from matchloom.plans.q_classify import classified
from matchloom.plans.q_evaluate import raw_metrics, sql_mean
from matchloom.plans.q_feed import events as feed_events
from matchloom.plans.q_signals import signals
from matchloom.plans.registry import cte, query, table
from matchloom.plans.sqltext import rx
from matchloom.sources import dims


@query("store_health", """
  SELECT count(*) AS rows_total, count(*) FILTER (c_custkey % 9 <> 0) AS rows_current,
    CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (c_custkey % 9 <> 0) < count(*) THEN 'stale_versions' ELSE 'ok' END AS status FROM customer""")
def store_health(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 9 == 0, "0.9.0").otherwise("1.0.0").alias("signals_version"))
    return mon.store_health(rows, "1.0.0")


_DIMS = {"role_family": "role_family", "seniority": "seniority", "tenure_flag": "tenure_flag"}


@query("signal_distribution", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {c} AS level, count(*) AS n, count(*) FILTER (confidence < 0.5) AS low_confidence, "
    f"min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM signals GROUP BY ALL"
    for d, c in {**_DIMS, "all": "'all'"}.items()), ("signals",))
def signal_distribution(spark, sf):
    return mon.distribution(signals(spark, sf), list(_DIMS), "confidence")


@query("arm_verdicts", """
  SELECT doc_id, max(CASE WHEN arm = 'length' THEN v END) AS length, max(CASE WHEN arm = 'quality' THEN v END) AS quality,
    max(CASE WHEN arm = 'toxic' THEN v END) AS toxic FROM (
    SELECT doc_id, 'quality' AS arm, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', 1 - toxic FROM labels
    UNION ALL SELECT doc_id, 'length', CASE WHEN n_chars > 200 THEN 1 ELSE 0 END FROM documents) GROUP BY doc_id""")
def arm_verdicts(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    rows = union_all([
        labels.select("doc_id", F.lit("quality").alias("arm"), F.col("quality").cast("int").alias("v")),
        labels.select("doc_id", F.lit("toxic").alias("arm"), (1 - F.col("toxic")).cast("int").alias("v")),
        docs.select("doc_id", F.lit("length").alias("arm"), F.when(F.col("n_chars") > 200, 1).otherwise(0).alias("v"))])
    return rows.groupBy("doc_id").pivot("arm", ["length", "quality", "toxic"]).agg(F.max("v"))


_M = ["ndcg_10", "precision_5", "mrr"]


@query("system_delta", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, a, b, {rx('(b - a)', 4)} AS delta FROM (SELECT {rx('a', 4)} AS a, "
    f"{rx('b', 4)} AS b FROM (SELECT (SELECT {sql_mean(m)} FROM raw_list_a) AS a, (SELECT {sql_mean(m)} FROM raw_list_b) AS b))" for m in _M),
    ("raw_list_a", "raw_list_b"))
def system_delta(spark, sf):
    parts = raw_metrics(spark, sf)
    means = ev.macro(parts["a"].unionByName(parts["b"]), _M, ["system"])
    long = means.select("system", F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(m).alias("x")) for m in _M])).alias("p")).select("system", "p.*")
    wide = long.groupBy("metric").pivot("system", ["a", "b"]).agg(F.max("x"))
    return wide.select("metric", "a", "b", round_exact(F.col("b") - F.col("a"), 4).alias("delta"))


@query("feed_reach", f"""
  SELECT materiality, events, entities, recomputed, {rx('(events::DOUBLE / total)', 4)} AS share FROM (
    SELECT materiality, count(*) AS events, count(DISTINCT entity) AS entities, count(DISTINCT entity) FILTER (affected <> '') AS recomputed,
      (SELECT count(*) FROM events_all) AS total FROM events_all GROUP BY materiality)""", ("events_all",))
def feed_reach(spark, sf):
    return mon.feed_reach(feed_events(spark, sf))


@query("drift_alarms", f"""
  SELECT day, rule, rate, alarm FROM (
    SELECT day, 'share:' || event_type AS rule, {rx('s', 6)} AS rate, coalesce(k >= 3 AND abs(s - m) > d * 3, FALSE) AS alarm FROM (
      SELECT *, count(*) OVER w AS k, avg(s) OVER w AS m, stddev(s) OVER w AS d FROM (SELECT day, event_type, n / sum(n) OVER (PARTITION BY day)::DOUBLE AS s
        FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2))
      WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
  UNION ALL SELECT day, 'abstention', {rx('r', 6)}, r > 0.25 FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS r FROM events GROUP BY 1)
  UNION ALL SELECT day, 'fallback', {rx('r', 6)}, r > 0.15 FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE AS r FROM events GROUP BY 1)
  UNION ALL SELECT day, 'p95', {rx('v', 6)}, v > 8 FROM (SELECT day, l[least(len(l), CAST(floor(len(l) * 0.95::DOUBLE) AS BIGINT) + 1)] AS v
    FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1))
  UNION ALL SELECT day, 'noise', {rx('r', 6)}, r < 0.4 FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type IN ('view', 'click')) / count(*)::DOUBLE AS r FROM events GROUP BY 1)
  UNION ALL SELECT day, 'deletion', {rx('r', 6)}, r > 0.05 FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_id % 17 = 0) / count(*)::DOUBLE AS r FROM events GROUP BY 1)
  UNION ALL SELECT day, 'mean', {rx('m', 6)}, coalesce(lag(m) OVER (ORDER BY day) - m > 0.05, FALSE) FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(v) / 100.0::DOUBLE / count(*) AS m FROM (SELECT ts, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY 1)""")
def drift_alarms(spark, sf):
    rows = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    shares = mon.class_share_alarms(rows, "day", "event_type").select(
        "day", F.concat(F.lit("share:"), "event_type").alias("rule"), F.col("share").alias("rate"), "alarm")
    rates = mon.rate_alarms(rows, "day", {
        "abstention": (F.col("event_type") == "error", "above", fv.ALARM_ABSTENTION),
        "noise": (F.col("event_type").isin("view", "click"), "below", fv.ALARM_NOISE_SHARE),
        "fallback": (F.col("event_type") == "purchase", "above", fv.ALARM_FALLBACK),
        "deletion": (F.col("event_id") % 17 == 0, "above", fv.ALARM_DELETION_RATE)})
    # Cents are summed as integers so that the mean does not depend on the order.
    cents = rows.groupBy("day").agg((F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0
                                     / F.count(F.lit(1))).alias("m"))
    means = mon.mean_drop_alarms(cents, "day", F.col("m")).select(
        "day", F.lit("mean").alias("rule"), F.col("mean").alias("rate"), "alarm")
    return union_all([shares, rates, means, mon.percentile_alarms(rows, "day", "value")])


@query("cost_projection", f"""
  SELECT event_type AS stage, rows, {rx('(p * 1000)', 4)} AS ms_per_row, {rx('(p * 1000000 / 3600.0::DOUBLE)', 4)} AS cpu_hours_per_million,
    {rx(f'(p * 1000000 / 3600.0::DOUBLE * {fv.PRICE_VCPU_HOUR + 2.0 * fv.PRICE_GB_HOUR}::DOUBLE)', 4)} AS dollars_per_million
  FROM (SELECT event_type, count(*) AS rows, sum(CAST(round(value * 100) AS BIGINT)) / count(*)::DOUBLE AS p FROM events GROUP BY event_type)""")
def cost_projection(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("event_type", "stage")
    return mon.cost_projection(rows, "stage", F.round(F.col("value") * 100).cast("bigint"), F.lit(1))


@query("exact_percentiles", """
  SELECT event_type, v[CAST(len(v) // 2 AS BIGINT) + 1] AS p50, v[least(len(v), CAST(floor(len(v) * 0.95::DOUBLE) AS BIGINT) + 1)] AS p95
  FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)""")
def exact_percentiles(spark, sf):
    n = F.col("n")
    found = selected_values(table(spark, sf, "events"), "value", {
        "p50": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * 0.95))}, ["event_type"])
    return found.groupBy("event_type").pivot("pick", ["p50", "p95"]).agg(F.max("value"))


@query("skill_totals", """
  SELECT sum(len(core_skills)) AS evidenced, sum(len(claimed)) AS claimed,
    count(*) FILTER (len(core_skills) > 0) AS rows_evidenced, count(*) FILTER (len(claimed) > 0) AS rows_claimed FROM signals""", ("signals",))
def skill_totals(spark, sf):
    return mon.skill_totals(signals(spark, sf))


@query("stage_counters", """
  SELECT 'classify' AS stage, count(*) AS rows_out, count(*) FILTER (family IS NULL) AS abstained FROM classified""", ("classified",))
def stage_counters(spark, sf):
    """Counters taken while the stage's own result is written, not by counting it again."""
    rows, seen = mon.observed(classified(spark, sf), "classify", abstained=F.count(F.when(F.col("cls").isNull(), 1)))
    rows.write.format("noop").mode("overwrite").save()
    found = seen.get
    return spark.createDataFrame([("classify", found["rows_out"], found["abstained"])],
                                 "stage string, rows_out bigint, abstained bigint")


@query("dim_checks", """
  SELECT 'overlap' AS rule, (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS findings
  UNION ALL SELECT 'unknown', (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
  UNION ALL SELECT 'sum', (SELECT CASE WHEN abs(sum(n_regionkey) - 50) > 0.000001 THEN 1 ELSE 0 END FROM nation)
  UNION ALL SELECT 'symmetry', (SELECT count(*) FROM (SELECT DISTINCT c_nationkey AS a, n_regionkey AS b FROM customer JOIN nation ON n_nationkey = c_nationkey) x
    WHERE NOT EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey = x.b AND n_regionkey = x.a))""")
def dim_checks(spark, sf):
    """Findings of each dictionary check over pairs of tables."""
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    pairs = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_nationkey").cast("bigint").alias("a"), F.col("n_regionkey").cast("bigint").alias("b")).distinct()
    found = {
        "overlap": dims.overlaps(customer.select(F.col("c_nationkey").alias("k")),
                                 table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), "k"),
        "unknown": dims.unknown_values(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]),
        "sum": dims.sums_to(nation, "n_regionkey", 50),
        "symmetry": dims.one_sided(pairs, "a", "b")}
    return union_all([rows.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("rule"), "findings")
                      for name, rows in found.items()])
