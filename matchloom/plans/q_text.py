"""Queries over scans, coercion, stores and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom import vocabulary as vocab
from matchloom.functions import coerce as co
from matchloom.functions import hashing as hs
from matchloom.functions import text as tx
from matchloom.operators import classify as cl
from matchloom.operators import inference as inf
from matchloom.plans import demo
from matchloom.plans.registry import cte, query, table
from matchloom.plans.sqltext import any_phrase, joined, norm, sql_list, values
from matchloom.sources import dims, jsonl, store

EVENT_RAW = ("CASE WHEN event_id % 17 = 0 THEN substr(props, 1, 4) "
             "WHEN event_id % 23 = 0 THEN ' ' ELSE props END")


@query("scan_json_quarantine", f"""
  SELECT event_id, raw, CASE WHEN json_valid(raw) THEN 'good' ELSE 'quarantine' END AS lane,
    CAST(CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.k') END AS BIGINT) AS k
  FROM (SELECT event_id, {EVENT_RAW} AS raw FROM events) WHERE trim(raw) <> ''""")
def scan_json_quarantine(spark, sf):
    lines = table(spark, sf, "events").select("event_id", F.expr(EVENT_RAW).alias("raw"))
    good, bad = jsonl.split_json(lines, "raw", "k bigint", ["event_id"])
    nothing = F.lit(None).cast("bigint")
    return good.select("event_id", F.col("_raw").alias("raw"), F.lit("good").alias("lane"), "k"
                       ).unionByName(bad.select("event_id", F.col("_raw").alias("raw"),
                                                F.lit("quarantine").alias("lane"),
                                                nothing.alias("k")))


LOOSE = ("CASE event_id % 6 WHEN 0 THEN '1,2' || CAST(event_id % 90 + 10 AS VARCHAR(20)) "
         "WHEN 1 THEN ' ' || CAST(event_id % 50 AS VARCHAR(20)) || '.75 ' WHEN 2 THEN 'junk' WHEN 3 THEN '' "
         "WHEN 4 THEN CAST(event_id % 2 AS VARCHAR(20)) ELSE CASE WHEN event_id % 4 = 1 THEN ' Yes' "
         "ELSE 'FALSE' END END")


@query("coerce_types", f"""
  SELECT event_id, CAST(trunc(try_cast(replace(trim(raw), ',', '') AS DOUBLE)) AS BIGINT) AS as_int,
    CASE WHEN lower(trim(raw)) IN ('true', 'yes', 'y', '1') THEN TRUE
         WHEN lower(trim(raw)) IN ('false', 'no', 'n', '0') THEN FALSE END AS as_bool
  FROM (SELECT event_id, {LOOSE} AS raw FROM events)""")
def coerce_types(spark, sf):
    raw = table(spark, sf, "events").select("event_id", F.expr(LOOSE).alias("raw"))
    return raw.select("event_id", co.to_int(F.col("raw")).alias("as_int"),
                      co.to_bool(F.col("raw")).alias("as_bool"))


@query("upsert_latest", """
  SELECT user_id, event_type, event_id, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn
    FROM events) WHERE rn = 1""")
def upsert_latest(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    old, new = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return store.upsert(old, new, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("append_dedup", """
  SELECT key, min(event_id) AS event_id FROM (
    SELECT user_id || '-' || event_type || '-' || CAST(event_id % 40 AS VARCHAR) AS key, event_id
    FROM events WHERE event_id % 3 <> 0)
  WHERE key NOT IN (SELECT user_id || '-' || event_type || '-' || CAST(event_id % 40 AS VARCHAR)
                    FROM events WHERE event_id % 3 = 0)
  GROUP BY key""")
def append_dedup(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.concat_ws(
        "-", F.col("user_id").cast("string"), "event_type",
        (F.col("event_id") % 40).cast("string")).alias("key"))
    return store.append_new(events.where("event_id % 3 = 0"), events.where("event_id % 3 <> 0"),
                            "key", ["event_id"])


@query("dim_conflicts", """
  SELECT p_name, count(DISTINCT p_type) AS n_values, min(p_type) AS first_value,
    max(p_type) AS last_value, arg_min(p_type, p_partkey) AS chosen
  FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1""")
def dim_conflicts(spark, sf):
    part = table(spark, sf, "part")
    found = dims.conflicts(part, "p_name", "p_type")
    chosen = dims.first_wins(part, "p_name", "p_type", "p_partkey")
    return found.join(chosen.withColumnRenamed("p_type", "chosen"), "p_name")


@query("norm_text", f"SELECT doc_id, {norm('text')} AS normed FROM documents")
def norm_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.norm_text(F.col("text")).alias("normed"))


DECORATED = "'\U0001f680' || source || ' ✨️' || lang || '‍' || text"


@query("strip_emoji", f"""
  SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (
    SELECT doc_id, regexp_replace({DECORATED},
      '{tx.PICTOGRAPHS}', '', 'g') AS s FROM documents)""")
def strip_emoji(spark, sf):
    plain = tx.strip_emoji(F.expr(DECORATED))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(plain).cast("bigint").alias("n"), F.md5(plain).alias("digest"))


SUFFIXED = ("CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', ' & ') || ' Pvt. Ltd.' "
            "WHEN 1 THEN c_name || ', Inc.' WHEN 2 THEN 'Coco ' || c_name || ' Labs India' "
            "ELSE upper(c_name) END")


@query("norm_company", f"""
  SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(
      replace({norm(SUFFIXED)}, '&', ' and '), '[^\\w\\s]', ' ', 'g'),
      '\\b({"|".join(fv.LEGAL_SUFFIXES)})\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS company
  FROM customer""")
def norm_company(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", tx.norm_company(tx.norm_text(F.expr(SUFFIXED))).alias("company"))


_ALIASES = vocab.alias_map()
cte("alias", f"SELECT * FROM (VALUES {values(_ALIASES.items())}) t(variant, canonical)")
RAW_SKILL = demo.SKILLS + ["(Redis)", "three.js", "C++", "apache_airflow", "Django JS", "JS"]
_PS = f"({sql_list(RAW_SKILL)})[1 + p_partkey % {len(RAW_SKILL)}]"


def sql_norm_skill(source: str, raw: str, out: str, keep: str, aliased: bool = True) -> str:
    """Chain of SELECTs that canonicalises ``raw`` of ``source``."""
    base = (f"SELECT {keep}, trim(regexp_replace(replace(regexp_replace({norm(raw)}, "
            f"'^[^\\w]+|[^\\w]+$', '', 'g'), '_', ' '), '\\s+', ' ', 'g')) AS t0 FROM {source}")
    base = (f"SELECT *, CASE WHEN trim(regexp_replace(t0, '(\\.js|\\s+js|-js|js)$', '')) <> '' "
            f"THEN trim(regexp_replace(t0, '(\\.js|\\s+js|-js|js)$', '')) ELSE t0 END AS t1 "
            f"FROM ({base})")
    if not aliased:
        return f"SELECT {keep}, t1 AS {out} FROM ({base})"
    return (f"SELECT {keep}, coalesce(a.canonical, b.canonical, t1) AS {out} FROM ({base}) s "
            f"LEFT JOIN alias a ON a.variant = t0 LEFT JOIN alias b ON b.variant = t1")


@query("norm_skill", sql_norm_skill(
    f"(SELECT p_partkey, {_PS} || CASE WHEN p_brand = 'Brand#1' THEN ' ✨' ELSE '' END AS r "
    "FROM part)", "r", "skill", "p_partkey"), ("alias",))
def norm_skill(spark, sf):
    raw = F.concat(demo.pick_from(RAW_SKILL, F.col("p_partkey") % len(RAW_SKILL)),
                   F.when(F.col("p_brand") == "Brand#1", " ✨").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", tx.norm_skill(
        tx.norm_text(raw), tx.literal_map(_ALIASES)).alias("skill"))


def sql_title(source: str, raw: str, keep: str) -> str:
    """Adds core and prefixes of a raw title."""
    words = "|".join(w.replace(".", "\\.") for w in fv.LEVEL_PREFIXES)
    marks = "|".join(fv.LEVEL_SUFFIXES)
    s = (f"SELECT {keep}, replace(regexp_replace(regexp_extract({norm(raw)}, '^([^|]*)', 1), "
         f"'(\\s+@\\s+|\\s+@|@\\s+|\\s+at\\s+).*$', ''), '&', ' and ') AS a FROM {source}")
    s = (f"SELECT {keep}, regexp_replace(regexp_replace(trim(regexp_replace(a, '[^\\w+#/. -]', ' ', 'g')),"
         f" '\\s+', ' ', 'g'), '^[ .-]+|[ .-]+$', '', 'g') AS b FROM ({s})")
    s = (f"SELECT {keep}, regexp_replace(b, '\\b(sde|swe|mts|sse)[-\\s]?([1-4]|i{{1,3}}|iv)\\b', "
         f"'\\1 \\2', 'g') AS t FROM ({s})")
    s = f"SELECT *, regexp_extract(t, '^((?:(?:{words})(?: |$))*)', 1) AS front FROM ({s})"
    s = f"SELECT *, substr(t, length(front) + 1) AS rest FROM ({s})"
    s = f"SELECT *, regexp_extract(rest, '((?:(?:^| )(?:{marks}))*)$', 1) AS back FROM ({s})"
    return (f"SELECT {keep}, CASE WHEN trim(substr(rest, 1, length(rest) - length(back))) <> '' "
            f"THEN trim(substr(rest, 1, length(rest) - length(back))) ELSE t END AS core, "
            f"array_to_string(list_concat(list_filter(string_split(trim(front), ' '), lambda w: w <> ''), "
            f"list_reverse(list_filter(string_split(trim(back), ' '), lambda w: w <> ''))), ' ') AS prefixes "
            f"FROM ({s})")


TITLED = ("CASE p_partkey % 6 WHEN 0 THEN 'Sr. ' || p_name || ' III' WHEN 1 THEN p_name || ' at ' || p_brand "
          "WHEN 2 THEN 'Lead ' || p_type || ' @ ' || p_brand || ' | x' WHEN 3 THEN 'SDE-2 & ' || p_name "
          "WHEN 4 THEN 'Senior II' ELSE ' -' || p_name || '. ' END")


@query("norm_title", sql_title(f"(SELECT p_partkey, {TITLED} AS r FROM part)", "r", "p_partkey"))
def norm_title(spark, sf):
    split = table(spark, sf, "part").select(
        "p_partkey", tx.norm_title(tx.norm_text(F.expr(TITLED))).alias("t"))
    return split.select("p_partkey", "t.core", F.array_join("t.prefixes", " ").alias("prefixes"))


@query("tokens_count", f"""
  SELECT doc_id, len(w) AS n_tokens, list_unique(w) AS n_distinct FROM (
    SELECT doc_id, regexp_extract_all({norm('text')}, '([a-z0-9+#.]+)', 1) AS w FROM documents)""")
def tokens_count(spark, sf):
    words = table(spark, sf, "documents").select(
        "doc_id", tx.tokens(tx.norm_text(F.col("text"))).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"),
                        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


NEEDLES = ["the", "of the", "ha", "than"]


@query("phrase_match", "SELECT doc_id, " + ", ".join(
    f"{any_phrase(norm('text'), [n])} AS has_{i}" for i, n in enumerate(NEEDLES)) + " FROM documents")
def phrase_match(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tx.norm_text(F.col("text")).alias("t"))
    return docs.select("doc_id", *[tx.has_phrase(F.col("t"), n).alias(f"has_{i}")
                                   for i, n in enumerate(NEEDLES)])


@query("label_slug", f"""
  SELECT s_suppkey, substr(regexp_replace(regexp_replace({norm("s_name || ' / (Tier ' || s_nationkey || ') & Co.'")},
    '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS label FROM supplier""")
def label_slug(spark, sf):
    raw = F.concat("s_name", F.lit(" / (Tier "), F.col("s_nationkey").cast("string"),
                   F.lit(") & Co."))
    return table(spark, sf, "supplier").select(
        "s_suppkey", tx.label_slug(tx.norm_text(raw)).alias("label"))


@query("input_hash", """
  SELECT c_custkey, 'sha256:' || sha256('{"id":' || c_custkey || ',"name":"' || c_name || '","nation":'
    || c_nationkey || ',"note":null,"segment":"' || c_mktsegment || '"}') AS input_hash FROM customer""")
def input_hash(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"), F.lit(None).cast("string").alias("note"),
        F.col("c_mktsegment").alias("segment"), F.lit("2024-01-01").alias("updated_at"))
    return rows.select(F.col("id").alias("c_custkey"), hs.input_hash(rows).alias("input_hash"))


@query("group_value", f"""
  SELECT l_suppkey, {joined('brands')} AS brands, 'sha256:' || sha256(to_json(brands)) AS group_hash FROM (
    SELECT l_suppkey, list_sort(list(DISTINCT lower(trim(p_brand)))) AS brands
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)""")
def group_value(spark, sf):
    pairs = table(spark, sf, "lineitem").join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_suppkey", "p_brand")
    # At most one item per brand, so the set is bounded by the brand list.
    sets = pairs.groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("b"))
    value = hs.set_group_value(F.col("b"))
    return sets.select("l_suppkey", F.array_join(value, "|").alias("brands"),
                       hs.set_group_hash(F.col("b")).alias("group_hash"))


@query("field_hash", f"""
  SELECT entity, grp, 'sha256:' || sha256(to_json(v)) AS field_hash FROM (
    SELECT doc_id AS entity, 'about' AS grp, {norm('text')} AS v FROM documents
    UNION ALL SELECT doc_id, 'headline', {norm("upper(lang) || '  ' || source")} FROM documents)""")
def field_hash(spark, sf):
    docs = table(spark, sf, "documents")
    headline = F.concat(F.upper("lang"), F.lit("  "), "source")
    groups = F.array(
        F.struct(F.lit("about").alias("grp"), hs.group_hash("about", F.col("text")).alias("h")),
        F.struct(F.lit("headline").alias("grp"), hs.group_hash("headline", headline).alias("h")))
    return docs.select(F.col("doc_id").alias("entity"), F.explode(groups).alias("g")).select(
        "entity", "g.grp", F.col("g.h").alias("field_hash"))


@query("text_fallback", """
  SELECT doc_id, md5(CASE WHEN doc_id % 3 <> 0 THEN text ELSE array_to_string(list_filter(
    [lang, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, text], lambda p: p <> ''), ' | ')
    END) AS digest FROM documents""")
def text_fallback(spark, sf):
    full = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    parts = [F.col("lang"), F.when(F.col("doc_id") % 2 != 0, F.col("source")),
             F.col("text")]
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.text_fallback(full, parts)).alias("digest"))


_LINE = ("'- ' || role || ' at ' || company_name || ' (' || start_date || ' to ' || "
         "coalesce(end_date, 'present') || ', ' || coalesce(CAST(duration_months AS VARCHAR), 'None') || "
         "' months): ' || coalesce(description, '') || ' [' || array_to_string(skills_used, ', ') || ']'")


@query("prompt_text", f"""
  SELECT p.id, count(*) AS entries, md5('Classify.' || chr(10) || chr(10) || 'Profile:' || chr(10) || 'headline: '
    || coalesce(headline, '') || chr(10) || 'skills: ' || array_to_string(skills, ', ') || chr(10)
    || 'experience:' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY e.ix) || chr(10) || chr(10) || 'Which class?') AS digest
  FROM entries e JOIN people p ON e.id = p.id GROUP BY p.id, headline, skills""", ("entries", "people"))
def prompt_text(spark, sf):
    line = inf.entry_line(*[F.col(c) for c in (
        "role", "company_name", "start_date", "end_date", "duration_months", "description",
        "skills_used")])
    # A prompt holds all entries of its profile, in order.
    lines = demo.entries(spark, sf).groupBy("id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.transform(F.array_sort(F.collect_list(F.struct("ix", line.alias("line")))), lambda e: e["line"]).alias("lines"))
    both = lines.join(demo.people(spark, sf).select("id", "headline", "skills"), "id")
    return both.select("id", "entries", F.md5(inf.prompt(
        F.col("headline"), F.col("skills"), F.col("lines"), "Classify.", "Which class?"))
        .alias("digest"))


REPLY = ("CASE event_id % 5 WHEN 0 THEN 'no object here' WHEN 1 THEN 'Sure: {\"family\": broken} ok' "
         "ELSE 'Sure! {\"family\": \"' || event_type || '\", \"k\": ' || event_id || '} done.' END")


@query("parse_reply", f"""
  SELECT event_id, good IS NOT NULL AS valid_json, json_extract_string(good, '$.family') AS family,
    coalesce(json_extract_string(good, '$.family') IN (SELECT event_type FROM events WHERE value > 0 AND event_type <> 'error'), FALSE)
      AS valid_value
  FROM (SELECT event_id, CASE WHEN json_valid(cut) THEN cut END AS good FROM (SELECT event_id,
    nullif(regexp_extract({REPLY}, '(?s)\\{{.*\\}}'), '') AS cut FROM events))""")
def parse_reply(spark, sf):
    events = table(spark, sf, "events")
    replies = events.select("event_id", F.expr(REPLY).alias("reply"))
    allowed = events.where("value > 0 and event_type <> 'error'").select(
        F.col("event_type").alias("family")).distinct()
    return inf.parse_reply(replies, "reply", "family string, k bigint", "family", allowed).select(
        "event_id", "valid_json", "family", "valid_value")


@query("inference_misses", """
  SELECT min(doc_id) AS doc_id, key FROM (SELECT doc_id,
    sha256('model-a' || chr(0) || lower(text) || chr(0) || '{}') AS key FROM documents)
  WHERE key NOT IN (SELECT sha256('model-a' || chr(0) || lower(text) || chr(0) || '{}')
                    FROM documents WHERE doc_id % 4 = 0)
  GROUP BY key""")
def inference_misses(spark, sf):
    work = table(spark, sf, "documents").select(
        "doc_id", inf.cache_key("model-a", F.lower("text"), "{}").alias("key"))
    folded = work.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return inf.misses(folded, "key", work.where("doc_id % 4 = 0"))
