"""Queries over dates and spells."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import dates as dt
from matchloom.operators import spans as sp
from matchloom.plans import demo
from matchloom.plans.registry import cte, query, shared, table
from matchloom.plans.sqltext import months, rx

AS_OF = f"DATE '{demo.AS_OF}'"


def sql_date(x: str) -> str:
    head = f"regexp_extract(trim({x}), '^([^T]*)', 1)"
    return (f"CAST(CASE WHEN regexp_matches({head}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN try_strptime({head}, '%Y-%m-%d') "
            f"WHEN regexp_matches({head}, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$') THEN try_strptime({head}, '%Y/%m/%d') "
            f"WHEN regexp_matches({head}, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}$') THEN try_strptime({head}, '%d-%m-%Y') "
            f"WHEN regexp_matches({head}, '^[0-9]{{4}}-[0-9]{{1,2}}$') THEN try_strptime({head}, '%Y-%m') "
            f"WHEN regexp_matches({head}, '^[0-9]{{4}}$') THEN try_strptime({head}, '%Y') END AS DATE)")


cte("spans", f"""
  SELECT *, {months('start_on', 'end_on')} AS months,
    coalesce(abs(duration_months - {months('start_on', 'end_on')}) > 2, FALSE) AS off_length
  FROM (SELECT *, CASE WHEN s IS NOT NULL THEN greatest(coalesce(e, {AS_OF}), s) END AS end_on,
      s AS start_on, s IS NOT NULL AND (coalesce(is_current, FALSE) OR e IS NULL) AS is_open,
      s IS NULL OR (e IS NULL AND coalesce(end_date, '') <> '') OR coalesce(e, {AS_OF}) < s AS bad_date,
      s IS NOT NULL AND e IS NULL AND NOT coalesce(is_current, FALSE) AS open_ended
    FROM (SELECT *, {sql_date('start_date')} AS s, {sql_date('end_date')} AS e FROM entries))""",
    ("entries",))


@shared
def spans(spark, sf):
    return sp.resolve_spans(demo.entries(spark, sf), demo.as_of())


@shared
def bare_spans(spark, sf):
    """Spans without skills, for queries that need dates only."""
    from matchloom.functions import coerce as co
    raw = demo.orders_as_entries(spark, sf)
    return sp.resolve_spans(raw.select(
        "*", co.to_bool(F.col("current_text")).alias("is_current"),
        co.to_int(F.col("duration_text")).alias("duration_months")), demo.as_of())


@query("parse_date", f"""
  SELECT ix, strftime({sql_date('start_date')}, '%Y-%m-%d') AS parsed FROM raw_entries""",
       ("raw_entries",))
def parse_date(spark, sf):
    return demo.orders_as_entries(spark, sf).select("ix", F.date_format(
        dt.parse_date(F.col("start_date")), "yyyy-MM-dd").alias("parsed"))


@query("whole_months", f"""
  SELECT l_orderkey, l_linenumber, {months('a', 'b')} AS m FROM (
    SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def whole_months(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    day = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    both = line.join(day, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", dt.whole_months(
        F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("m"))


@query("add_months", """
  SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 40 AS INTEGER)),
    '%Y-%m-%d') AS moved FROM orders""")
def add_months(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(F.add_months(
        F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")), "yyyy-MM-dd").alias("moved"))


@query("resolve_spans", """
  SELECT id, ix, strftime(start_on, '%Y-%m-%d') AS start_on, strftime(end_on, '%Y-%m-%d') AS end_on,
    months, is_open, bad_date, open_ended, start_on IS NOT NULL AND off_length AS off_length
  FROM spans""", ("spans",))
def resolve_spans(spark, sf):
    return bare_spans(spark, sf).select(
        "id", "ix", F.date_format("start_on", "yyyy-MM-dd").alias("start_on"),
        F.date_format("end_on", "yyyy-MM-dd").alias("end_on"), "months", "is_open", "bad_date",
        "open_ended", (F.col("start_on").isNotNull() & F.col("off_length")).alias("off_length"))


@query("snapshot_date", f"""
  SELECT strftime(coalesce((SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n
    FROM (SELECT {sql_date('start_date')} + to_months(CAST(duration_months AS INTEGER)) AS d FROM raw_entries
          WHERE is_current AND duration_months IS NOT NULL AND {sql_date('start_date')} IS NOT NULL))
    WHERE rn = n // 2 + 1), DATE '2000-01-01'), '%Y-%m-%d') AS snapshot""", ("raw_entries",))
def snapshot_date(spark, sf):
    rows = bare_spans(spark, sf)
    found = sp.snapshot_date(rows, F.to_date(F.lit("2000-01-01")), "start_date",
                             "duration_months", "is_current")
    return found.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot"))


@query("feed_as_of", """
  SELECT strftime(coalesce(max(CAST(ts AS DATE)), DATE '2000-01-01'), '%Y-%m-%d') AS as_of
  FROM events WHERE event_id % 7 <> 0""")
def feed_as_of(spark, sf):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    feed = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(at).alias("observed_at"))
    return sp.feed_as_of(feed, "observed_at", F.to_date(F.lit("2000-01-01"))).select(
        F.date_format("as_of", "yyyy-MM-dd").alias("as_of"))


cte("union_months", f"""
  SELECT id, CAST(sum({months('a', 'b')}) AS BIGINT) AS months_covered, count(*) AS islands FROM (
    SELECT id, island, min(start_on) AS a, max(end_on) AS b FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY start_on, end_on, ix) AS island FROM (
        SELECT id, ix, start_on, end_on, CASE WHEN start_on <= max(end_on) OVER (PARTITION BY id
          ORDER BY start_on, end_on, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          THEN 0 ELSE 1 END AS fresh FROM spans WHERE start_on IS NOT NULL))
    GROUP BY id, island) GROUP BY id""", ("spans",))


@query("interval_union", "SELECT id, months_covered, islands FROM union_months", ("union_months",))
def interval_union(spark, sf):
    return sp.interval_union(bare_spans(spark, sf))


cte("attributed", f"""
  SELECT a.id, a.ix, CAST(greatest(0, any_value(a.months) - coalesce(sum(CASE WHEN least(a.end_on, c.end_on) > c.start_on
      THEN {months('c.start_on', 'least(a.end_on, c.end_on)')} END), 0)) AS BIGINT) AS attributed
  FROM spans a LEFT JOIN spans c ON a.id = c.id AND c.start_on IS NOT NULL AND (c.start_on > a.start_on
    OR (c.start_on = a.start_on AND (c.end_on > a.end_on OR (c.end_on = a.end_on AND c.ix < a.ix))))
  WHERE a.start_on IS NOT NULL GROUP BY a.id, a.ix""", ("spans",))


@query("interval_attribution", "SELECT id, ix, attributed FROM attributed", ("attributed",))
def interval_attribution(spark, sf):
    return sp.attributed_months(bare_spans(spark, sf))


@query("entry_age", f"""
  SELECT ix, CASE WHEN is_open OR end_on >= {AS_OF} THEN 0 ELSE {months('end_on', AS_OF)} END AS age
  FROM spans WHERE start_on IS NOT NULL""", ("spans",))
def entry_age(spark, sf):
    rows = bare_spans(spark, sf).where("start_on is not null")
    return rows.select("ix", dt.entry_age(F.col("end_on"), F.col("is_open"), demo.as_of())
                       .alias("age"))


cte("tenure", f"""
  SELECT id, {rx('a', 1)} AS avg_tenure_months, jobs_last_36m,
    CASE WHEN a < 15 AND jobs_last_36m >= 3 THEN 'hopper' WHEN a >= 30 THEN 'stable' ELSE 'moderate' END AS tenure_flag
  FROM (SELECT id, CAST(coalesce(avg(CASE WHEN NOT is_open THEN months END), avg(months), 0) AS DOUBLE) AS a,
      count(*) FILTER ({months('start_on', AS_OF)} <= 36) AS jobs_last_36m
    FROM spans WHERE start_on IS NOT NULL GROUP BY id)""", ("spans",))


@query("tenure_stability", """
  SELECT i.id, coalesce(avg_tenure_months, 0.0::DOUBLE) AS avg_tenure_months, coalesce(jobs_last_36m, 0) AS jobs_last_36m,
    coalesce(tenure_flag, 'moderate') AS tenure_flag
  FROM (SELECT DISTINCT id FROM spans) i LEFT JOIN tenure t ON i.id = t.id""", ("tenure", "spans"))
def tenure_stability(spark, sf):
    return sp.tenure_stability(bare_spans(spark, sf), demo.as_of())


@query("current_spell", """
  SELECT id, CAST(coalesce(max(CASE WHEN is_open THEN months END), 0) AS BIGINT) AS current_months,
    arg_min(ix, ix) FILTER (is_open) AS current_ix,
    arg_min(ix, struct_pack(a := -epoch(end_on), b := ix)) FILTER (start_on IS NOT NULL) AS latest_ix
  FROM spans GROUP BY id""", ("spans",))
def current_spell(spark, sf):
    return sp.current_spell(bare_spans(spark, sf)).select(
        "id", "current_months", F.col("current.ix").alias("current_ix"),
        F.col("latest.ix").alias("latest_ix"))
