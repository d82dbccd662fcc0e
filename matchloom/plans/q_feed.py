"""Queries over the change feed: events are observations of (user, event type) fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import hashing as hs
from matchloom.functions import text as tx
from matchloom.operators import feed as fd
from matchloom.operators import merge as mg
from matchloom.operators import signals as sg
from matchloom.plans import demo
from matchloom.session import materialised
from matchloom.plans.q_signals import RULES, signals
from matchloom.plans.registry import CTES, cte, query, shared, table
from matchloom.plans.sqltext import joined, norm, q, rx
from matchloom.sources import store
from matchloom.streaming import feed as st

BASE_AT = "2024-01-02T00:00:00"
DEPENDS = {"click": ["intent", "recency"], "view": ["recency"], "purchase": ["intent", "value"],
           "signup": [], "error": ["quality"]}
LEVELS = {"purchase": "high", "signup": "medium", "click": "medium"}

# The base holds the first observation of most keys; every 17th value is null,
# every 41st record has no time, and every 13th repeats its time.
cte("feed", f"""
  SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS field_group, event_id AS ordinal, 'src' || (event_id % 3) AS source,
    CASE WHEN event_id % 41 = 0 THEN '' WHEN event_id % 13 = 0 THEN strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S')
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS observed_at,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'k' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 3
      || CASE WHEN event_id % 5 = 0 THEN '  ' ELSE '' END END AS value FROM events""")
cte("feed_hashed", f"SELECT *, CASE WHEN value IS NOT NULL THEN 'sha256:' || sha256('\"' || {norm('value')} || '\"') END AS hash FROM feed", ("feed",))
cte("base", f"""
  SELECT entity, field_group, arg_min(value, ordinal) AS base_value, arg_min(hash, ordinal) AS base_hash, '{BASE_AT}' AS base_at
  FROM feed_hashed WHERE value IS NOT NULL AND CAST(entity AS BIGINT) % 4 <> 0 GROUP BY entity, field_group""", ("feed_hashed",))
cte("marked", """
  SELECT f.*, b.base_value, b.base_hash, b.base_at, CASE WHEN b.base_at IS NOT NULL THEN observed_at <= b.base_at OR rn > 1
    WHEN born IS NULL OR NOT born THEN FALSE ELSE observed_at <= birth_at OR rn > 1 END AS stale
  FROM (SELECT *, row_number() OVER (PARTITION BY entity, field_group, observed_at ORDER BY ordinal) AS rn,
      coalesce(count(value) OVER w, 0) > 0 AS born,
      first_value(CASE WHEN value IS NOT NULL THEN observed_at END IGNORE NULLS) OVER (PARTITION BY entity, field_group ORDER BY observed_at, ordinal
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS birth_at
    FROM feed_hashed WINDOW w AS (PARTITION BY entity, field_group ORDER BY observed_at, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) f
  LEFT JOIN base b USING (entity, field_group)""", ("feed_hashed", "base"))
_W = "OVER (PARTITION BY entity, field_group ORDER BY observed_at, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
cte("changes", f"""
  SELECT *, coalesce(last_value(CASE WHEN change = 'applied' THEN value END IGNORE NULLS) {_W}, base_value) AS old_value
  FROM (SELECT *, CASE WHEN stale THEN 'stale_skip' WHEN value IS NULL THEN 'suspected_deletion'
      WHEN hash = coalesce(last_value(CASE WHEN NOT stale THEN hash END IGNORE NULLS) {_W}, base_hash) THEN 'noise' ELSE 'applied' END AS change FROM marked)""",
    ("marked",))
_ID = "'evt_' || substr(sha256('[\"' || entity || '\",\"' || observed_at || '\",\"' || change_type || '\",\"' || field || '\",' || CASE WHEN new_value IS NULL THEN 'null' ELSE '\"' || new_value || '\"' END || ']'), 1, 22)"
_AFF = "CASE field_group " + " ".join(f"WHEN {q(k)} THEN {q('|'.join(sorted(v)))}" for k, v in DEPENDS.items()) + " END"
cte("events_all", f"""
  SELECT *, {_ID} AS event_id FROM (
    SELECT entity, observed_at, ordinal, change, CASE WHEN change IN ('applied', 'noise') THEN 'field_update' ELSE change END AS change_type,
      field_group AS field, old_value, value AS new_value, CASE WHEN change IN ('stale_skip', 'noise') THEN 'noise'
        WHEN change = 'suspected_deletion' THEN 'low' ELSE 'low' END AS materiality,
      CASE WHEN change = 'applied' THEN {_AFF} ELSE '' END AS affected FROM changes
    UNION ALL SELECT entity, '', ordinal, 'malformed_record', 'malformed_record', '_observed_at', NULL, NULL, 'low', ''
      FROM feed WHERE observed_at = ''
    UNION ALL SELECT entity, arg_min(observed_at, observed_at || lpad(CAST(ordinal AS VARCHAR), 12, '0')), arg_min(ordinal, observed_at || lpad(CAST(ordinal AS VARCHAR), 12, '0')),
      'candidate_created', 'candidate_created', '_record', NULL, NULL, 'medium', '' FROM feed WHERE entity NOT IN (SELECT entity FROM base) GROUP BY entity)""",
    ("changes", "feed", "base"))
cte("state_next", """
  SELECT k.entity, k.field_group, coalesce(c.v, b.base_value) AS base_value, coalesce(c.h, b.base_hash) AS base_hash,
    CASE WHEN b.base_at IS NULL AND c.own IS NULL THEN NULL ELSE greatest(coalesce(b.base_at, c.t), coalesce(c.t, b.base_at)) END AS base_at
  FROM (SELECT entity, field_group FROM base UNION SELECT entity, field_group FROM feed) k LEFT JOIN base b USING (entity, field_group)
  LEFT JOIN (SELECT entity, field_group, list(value ORDER BY observed_at DESC, ordinal DESC) FILTER (change = 'applied')[1] AS v,
      list(hash ORDER BY observed_at DESC, ordinal DESC) FILTER (change IN ('applied', 'noise'))[1] AS h,
      max(observed_at) FILTER (change IN ('applied', 'noise')) AS own, max(observed_at) FILTER (change <> 'stale_skip') AS t
    FROM changes GROUP BY entity, field_group) c USING (entity, field_group)
  WHERE b.base_at IS NOT NULL OR c.own IS NOT NULL""".replace("FILTER (change = 'applied')[1]", "FILTER (change = 'applied')")
    .replace("FILTER (change IN ('applied', 'noise'))[1]", "FILTER (change IN ('applied', 'noise'))")
    .replace("coalesce(c.v, b.base_value)", "coalesce(c.v[1], b.base_value)").replace("coalesce(c.h, b.base_hash)", "coalesce(c.h[1], b.base_hash)"),
    ("base", "feed", "changes"))


def feed_of(events):
    """Feed rows of an events table, batch or streaming."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    day = F.date_format("ts", "yyyy-MM-dd'T00:00:00'")
    k = F.get_json_object("props", "$.k").cast("bigint") % 3
    value = F.concat(F.lit("k"), k.cast("string"), F.when(F.col("event_id") % 5 == 0, "  ").otherwise(""))
    rows = events.select(
        F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("field_group"),
        F.when(F.col("event_id") % 41 == 0, "").when(F.col("event_id") % 13 == 0, day).otherwise(at)
        .alias("observed_at"), F.col("event_id").alias("ordinal"),
        F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("source"),
        F.when(F.col("event_id") % 17 != 0, value).alias("value"))
    return rows.withColumn("hash", F.when(F.col("value").isNotNull(), hs.text_group_hash(F.col("value"))))


@shared
def feed(spark, sf):
    return feed_of(table(spark, sf, "events"))


@shared
def base(spark, sf):
    known = feed(spark, sf).where("value is not null and cast(entity as bigint) % 4 <> 0")
    first = known.groupBy("entity", "field_group").agg(
        F.min_by(F.struct("value", "hash"), "ordinal").alias("r")).select("entity", "field_group", "r.*")
    return fd.base_state(first, F.lit(BASE_AT))


@shared
def changes(spark, sf):
    return fd.mark_changes(fd.mark_stale(feed(spark, sf), base(spark, sf)))


@shared
def events(spark, sf):
    return fd.apply_feed(feed(spark, sf), base(spark, sf), dependencies=DEPENDS)


@query("feed_state", "SELECT entity, field_group, base_hash, base_at FROM base", ("base",))
def feed_state(spark, sf):
    return base(spark, sf).select("entity", "field_group", "base_hash", "base_at")


@query("feed_stale", "SELECT ordinal, stale FROM marked", ("marked",))
def feed_stale(spark, sf):
    return fd.mark_stale(feed(spark, sf), base(spark, sf)).select("ordinal", "stale")


def _lane(change: str):
    return f"SELECT ordinal, entity, field_group, old_value FROM changes WHERE change = '{change}'"


@query("feed_nulls", _lane("suspected_deletion"), ("changes",))
def feed_nulls(spark, sf):
    return changes(spark, sf).where("change = 'suspected_deletion'").select(
        "ordinal", "entity", "field_group", "old_value")


@query("feed_noise", _lane("noise"), ("changes",))
def feed_noise(spark, sf):
    return changes(spark, sf).where("change = 'noise'").select("ordinal", "entity", "field_group", "old_value")


@query("feed_current", "SELECT entity, field_group, base_value, base_hash, base_at FROM state_next", ("state_next",))
def feed_current(spark, sf):
    return fd.next_state(events(spark, sf), base(spark, sf))


@query("feed_created", "SELECT entity, observed_at, event_id FROM events_all WHERE change = 'candidate_created'", ("events_all",))
def feed_created(spark, sf):
    known = base(spark, sf).select("entity")
    return fd.record_events(feed(spark, sf), known).where("change = 'candidate_created'").select(
        "entity", "observed_at", "event_id")


@query("feed_malformed", "SELECT entity, ordinal, materiality FROM events_all WHERE change = 'malformed_record'", ("events_all",))
def feed_malformed(spark, sf):
    known = base(spark, sf).select("entity")
    return fd.record_events(feed(spark, sf), known).where("change = 'malformed_record'").select(
        "entity", "ordinal", "materiality")


_GROUPS = ["is_open_to_work", "location", "experience", "skills", "headline", "education", "about"]
_FLAG = ["true", "false", "yes", "0"]


@query("materiality", f"""
  SELECT event_id, CASE WHEN g = 'is_open_to_work' THEN CASE WHEN NOT o AND n THEN 'high' WHEN o AND NOT n THEN 'medium' ELSE 'low' END
    WHEN g = 'location' THEN 'high' WHEN g = 'experience' THEN CASE WHEN event_id % 3 < 2 THEN 'high' ELSE 'medium' END
    WHEN g = 'about' THEN 'low' ELSE 'medium' END AS materiality,
    CASE WHEN g = 'is_open_to_work' THEN CASE WHEN NOT o AND n THEN 're_score|notify_recruiter' WHEN o AND NOT n THEN 're_score' ELSE '' END
    WHEN g = 'location' OR (g = 'experience' AND event_id % 3 < 2) THEN 're_score|notify_recruiter' WHEN g = 'about' THEN '' ELSE 're_score' END AS downstream
  FROM (SELECT event_id, (['{"','".join(_GROUPS)}'])[1 + event_id % 7] AS g, user_id % 4 IN (0, 2) AS o, (user_id + event_id) % 4 IN (0, 2) AS n FROM events)""")
def materiality(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", demo.pick_from(_GROUPS, F.col("event_id") % 7).alias("g"),
        demo.pick_from(_FLAG, F.col("user_id") % 4).alias("old"),
        demo.pick_from(_FLAG, (F.col("user_id") + F.col("event_id")) % 4).alias("new"),
        demo.pick_from(["new_role", "current_role_ended", "entry_updated"], F.col("event_id") % 3).alias("kind"))
    rule = fd.materiality(F.col("g"), F.col("old"), F.col("new"), F.col("kind"))
    return rows.select("event_id", rule["materiality"].alias("materiality")).withColumn(
        "downstream", F.array_join(fd.downstream(F.col("materiality")), "|"))


@query("affected_signals", f"""
  SELECT user_id, coalesce(array_to_string(list_sort(list(DISTINCT s)), '|'), '') AS affected FROM (SELECT user_id,
    unnest(string_split(CASE event_type {" ".join(f"WHEN {q(k)} THEN {q('|'.join(v))}" for k, v in DEPENDS.items() if v)} END, '|')) AS s
    FROM events WHERE event_type <> 'signup') GROUP BY user_id""")
def affected_signals(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type").distinct().select(
        "user_id", F.explode(fd.affected(F.col("event_type"), DEPENDS)).alias("s"))
    return rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("s")), "|").alias("affected"))


@query("event_ids", f"SELECT ordinal, {_ID} AS event_id FROM (SELECT entity, observed_at, 'field_update' AS change_type, field_group AS field, value AS new_value, ordinal FROM feed)", ("feed",))
def event_ids(spark, sf):
    return feed(spark, sf).select("ordinal", fd.event_id(
        F.col("entity"), F.col("observed_at"), F.lit("field_update"), F.col("field_group"),
        F.col("value")).alias("event_id"))


@query("feed_apply", "SELECT event_id, entity, observed_at, ordinal, change_type, field, old_value, new_value, materiality, affected FROM events_all", ("events_all",))
def feed_apply(spark, sf):
    return events(spark, sf).select(
        "event_id", "entity", "observed_at", "ordinal", "change_type", "field", "old_value", "new_value",
        "materiality", F.array_join("affected_signals", "|").alias("affected"))


@query("feed_replay", """
  SELECT count(*) AS events, count(*) FILTER (s.entity IS NULL) AS unborn, CAST(0 AS BIGINT) AS material, CAST(0 AS BIGINT) AS moved
  FROM feed f LEFT JOIN state_next s USING (entity, field_group)""", ("feed", "state_next"))
def feed_replay(spark, sf):
    """The feed applied to its own result: over all keys, nothing material happens and no state moves.

    Keys that only ever saw nulls have no state; their records are null again (``unborn``).
    """
    after = materialised(fd.next_state(events(spark, sf), base(spark, sf)), "state")
    changed = materialised(fd.mark_changes(fd.mark_stale(feed(spark, sf), after)), "replay")
    state = fd.next_state(fd.field_events(changed, DEPENDS), after)
    moved = state.exceptAll(after).unionByName(after.exceptAll(state)).agg(F.count(F.lit(1)).alias("moved"))
    facts = changed.agg(
        F.count(F.lit(1)).alias("events"),
        F.count(F.when(F.col("base_at").isNull(), 1)).alias("unborn"),
        F.count(F.when(~F.col("change").isin("stale_skip", "noise", "suspected_deletion"), 1)).alias("material"))
    return facts.select("*", moved.select("moved").scalar().alias("moved"))


@query("recompute_dirty", f"""
  SELECT s.id, role_family, confidence, {joined('codes')} AS codes FROM signals s WHERE s.id IN (
    SELECT CAST(entity AS BIGINT) FROM events_all WHERE change = 'applied' AND affected <> '')""", ("signals", "events_all"))
def recompute_dirty(spark, sf):
    ids = fd.dirty_entities(events(spark, sf)).select(F.col("entity").cast("bigint").alias("id"))
    ids = materialised(ids, "dirty")
    people = demo.people(spark, sf).join(ids, "id", "left_semi")
    entries = demo.entries(spark, sf).join(ids, "id", "left_semi")
    weighted = materialised(sg.weighted_entries(entries, demo.as_of(), RULES), "dirty_entries")
    return sg.extract(people, None, demo.as_of(), RULES, weighted=weighted).select(
        "id", "role_family", "confidence", F.array_join("reason_codes", "|").alias("codes"))


@query("stale_entities", """
  SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'never_computed' WHEN c_custkey % 3 = 0 THEN 'input_changed' ELSE 'version_changed' END AS reason
  FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR c_custkey % 7 = 0""")
def stale_entities(spark, sf):
    k = F.col("c_custkey")
    now = table(spark, sf, "customer").select(k.alias("id"), F.sha2("c_name", 256).alias("input_hash"))
    done = table(spark, sf, "customer").where(k % 5 != 0).select(
        k.alias("id"), F.when(k % 3 == 0, "old").otherwise(F.sha2("c_name", 256)).alias("input_hash"),
        F.when(k % 7 == 0, "0.9.0").otherwise("1.0.0").alias("signals_version"))
    return fd.stale_signals(now, done, "1.0.0")


_COST = f"/ 3600.0::DOUBLE * {fv.PRICE_VCPU_HOUR + fv.PRICE_GB_HOUR}::DOUBLE"


@query("change_summary", f"""
  SELECT high_events, medium_events, low_events, noise_events, entities, recomputed, {rx('(entities::DOUBLE / recomputed)', 4)} AS factor,
    {rx(f'(entities * 0.5::DOUBLE {_COST})', 6)} AS full_cost, {rx(f'(recomputed * 0.5::DOUBLE {_COST})', 6)} AS incremental_cost
  FROM (SELECT count(*) FILTER (materiality = 'high') AS high_events, count(*) FILTER (materiality = 'medium') AS medium_events,
    count(*) FILTER (materiality = 'low') AS low_events, count(*) FILTER (materiality = 'noise') AS noise_events,
    (SELECT count(DISTINCT entity) FROM feed) AS entities, count(DISTINCT entity) FILTER (affected <> '') AS recomputed FROM events_all)""",
       ("events_all", "feed"))
def change_summary(spark, sf):
    total = feed(spark, sf).agg(F.count_distinct("entity").alias("n")).scalar()
    return fd.change_summary(events(spark, sf), total, 0.5)


# ------------------------------------------------------------------- lists
cte("merge_rows", "SELECT o_custkey, o_orderpriority, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, "
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders")


def merge_rows(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderpriority", "o_orderkey", F.when(k % 4 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"))


@query("merge_by_key", """
  SELECT o_custkey, o_orderpriority, list(price ORDER BY o_orderkey DESC) FILTER (price IS NOT NULL) AS p, list(status ORDER BY o_orderkey DESC) FILTER (status IS NOT NULL) AS s
  FROM merge_rows GROUP BY ALL""".join(["SELECT o_custkey, o_orderpriority, p[1] AS price, s[1] AS status FROM (", ")"]), ("merge_rows",))
def merge_by_key(spark, sf):
    return mg.merge_by_key(merge_rows(spark, sf), ["o_custkey", "o_orderpriority"], ["o_orderkey"], ["price", "status"])


@query("merge_append", """
  SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey, o_orderpriority, min(o_orderkey) FROM orders o WHERE o_orderkey % 2 = 1 AND NOT EXISTS (
    SELECT 1 FROM orders s WHERE s.o_orderkey % 2 = 0 AND s.o_custkey = o.o_custkey AND s.o_orderpriority = o.o_orderpriority) GROUP BY 1, 2""")
def merge_append(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return mg.merge_append(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"),
                           ["o_custkey", "o_orderpriority"], F.col("o_orderkey"))


@query("list_change_kind", """
  SELECT o_custkey, CASE WHEN bool_or(was IS NULL) THEN 'new_role' WHEN bool_or(was AND ended) THEN 'current_role_ended' ELSE 'entry_updated' END AS kind
  FROM (SELECT n.o_custkey, n.o_orderstatus <> 'P' AS ended, s.was FROM orders n LEFT JOIN (SELECT o_custkey, o_orderpriority, bool_or(o_orderstatus = 'O') AS was
      FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2) s USING (o_custkey, o_orderpriority) WHERE o_orderkey % 3 = 0) GROUP BY o_custkey""")
def list_change_kind(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "O").alias("current"),
        F.when(F.col("o_orderstatus") != "P", "x").alias("ended"), "o_orderkey")
    return mg.list_change_kind(rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 3 = 0"),
                               "o_custkey", ["o_orderpriority"], "current", "ended")


# The stream starts without state: the batch changes over an empty base.
cte("base_none", "SELECT entity, field_group, value AS base_value, hash AS base_hash, '' AS base_at FROM feed_hashed WHERE FALSE", ("feed_hashed",))
cte("marked_none", CTES["marked"][1].replace("LEFT JOIN base b", "LEFT JOIN base_none b"), ("feed_hashed", "base_none"))
cte("changes_none", CTES["changes"][1].replace("FROM marked", "FROM marked_none"), ("marked_none",))


@query("stream_feed", "SELECT field_group, change, count(*) AS n FROM changes_none GROUP BY field_group, change", ("changes_none",))
def stream_feed(spark, sf):
    schema = table(spark, sf, "events").schema
    source = st.admitted(spark, sf, schema, pathGlobFilter="events.parquet")
    out = st.run_batches(spark, feed_of(source), "stream_feed")
    return out.groupBy("field_group", "change").agg(F.count(F.lit(1)).alias("n"))
