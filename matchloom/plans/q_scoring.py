"""Queries over requirements, match scores and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions.numeric import round_exact
from matchloom.operators import classify as cl
from matchloom.operators import evaluate as ev
from matchloom.operators import requirements as rq
from matchloom.operators import scoring as sc
from matchloom.operators.skew import top_k
from matchloom.plans import demo
from matchloom.session import materialised
from matchloom.plans.q_signals import RULES, signals, sql_adj
from matchloom.plans.q_text import sql_norm_skill, sql_title
from matchloom.plans.registry import cte, query, shared, table
from matchloom.plans.sqltext import any_phrase, joined, norm, phrase, q, rx, sql_list, values

# ------------------------------------------------------------------ shared SQL
cte("dim_concept", "SELECT * FROM (VALUES " + values(
    [(c, s, i * 100 + j) for i, (c, items) in enumerate(fv.CONCEPT_SYNONYMS.items())
     for j, s in enumerate(items)]) + ") t(concept, synonym, ord)")
_EVIDENCE = " OR ".join(f"contains({norm('raw')}, {q(m)})" for m in fv.EVIDENCE_MARKERS)
_PAREN = r"\(([^)]*)\)"


def sql_requirements(texts: str) -> str:
    """raw, kind, label, alternatives and terms of the texts selected by ``texts``."""
    split = (f"SELECT raw, regexp_split_to_array(regexp_replace(raw, '{_PAREN}', ' ', 'g') || ' , ' || "
             f"array_to_string(regexp_extract_all(raw, '{_PAREN}', 1), ' '), "
             f"'\\s+or\\s+|\\s*/\\s*|\\s*,\\s*|\\s*\\|\\s*') AS parts FROM ({texts})")
    parts = f"SELECT raw, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS part FROM ({split})"
    fillers = "|".join(fv.REQUIREMENT_FILLERS)
    clean = (f"SELECT raw, pos, trim(regexp_replace(regexp_replace({norm('part')}, '\\b({fillers})\\b', ' ', 'g'), "
             f"'\\s+', ' ', 'g')) AS cleaned FROM ({parts})")
    names = (f"SELECT raw, pos, -1 AS k, cleaned AS name FROM ({clean}) WHERE cleaned <> '' UNION ALL "
             f"SELECT raw, pos, ord, synonym FROM ({clean}) JOIN dim_concept ON contains(cleaned, concept)")
    canon = sql_norm_skill(f"({names})", "name", "alt", "raw, pos, k")
    alts = (f"SELECT raw, list(alt ORDER BY pos, k) AS alternatives FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY raw, alt ORDER BY pos, k) AS rn FROM ({canon}) WHERE alt <> '') WHERE rn = 1 GROUP BY raw")
    return (f"SELECT t.raw, CASE WHEN {_EVIDENCE.replace('raw', 't.raw')} THEN 'evidence' ELSE 'skill' END AS kind, "
            f"substr(regexp_replace(regexp_replace({norm('t.raw')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS label, "
            f"coalesce(a.alternatives, []::VARCHAR[]) AS alternatives, CASE WHEN {_EVIDENCE.replace('raw', 't.raw')} THEN "
            f"list_filter(regexp_extract_all({norm('t.raw')}, '([a-z0-9-]+)', 1), lambda w: NOT list_contains("
            f"{sql_list(fv.EVIDENCE_STOP_WORDS)}, w) AND length(w) > 2) ELSE []::VARCHAR[] END AS terms "
            f"FROM ({texts}) t LEFT JOIN ({alts}) a USING (raw)")


REQUIREMENTS = sorted({t for row in demo.JOB_MUST + demo.JOB_GOOD for t in row})
_REQ_TEXT = (f"(({sql_list(REQUIREMENTS)})[1 + s_suppkey % {len(REQUIREMENTS)}] || ' or ' || s_name "
             "|| CASE WHEN s_nationkey % 5 = 0 THEN ' in production at scale' ELSE '' END)")


@query("requirement_parse", f"""
  SELECT s_suppkey, kind, label, {joined('alternatives')} AS alternatives, {joined('terms')} AS terms
  FROM (SELECT s_suppkey, {_REQ_TEXT} AS raw FROM supplier) JOIN (
    {sql_requirements(f'SELECT DISTINCT {_REQ_TEXT} AS raw FROM supplier')}) USING (raw)""",
       ("dim_concept", "alias"))
def requirement_parse(spark, sf):
    text = F.concat(
        demo.pick_from(REQUIREMENTS, F.col("s_suppkey") % len(REQUIREMENTS)), F.lit(" or "), "s_name",
        F.when(F.col("s_nationkey") % 5 == 0, " in production at scale").otherwise(""))
    parsed = table(spark, sf, "supplier").select("s_suppkey", text.alias("t")).select(
        "s_suppkey", F.transform(F.array("t"), lambda t: rq.requirement(t))[0].alias("r"))
    return parsed.select("s_suppkey", "r.kind", "r.label",
                         F.array_join("r.alternatives", "|").alias("alternatives"),
                         F.array_join("r.terms", "|").alias("terms"))


cte("job_class", f"""
  SELECT j.*, coalesce(x.family, v.family) AS job_family FROM jobs j JOIN (
    {sql_title('(SELECT DISTINCT title FROM jobs)', 'title', 'title')}) c ON c.title = j.title
  LEFT JOIN dim_pattern x ON x.pattern = c.core LEFT JOIN (
    SELECT raw_query, arg_max(family, score) AS family FROM (SELECT raw_query, family, sum(weight) AS score
      FROM (SELECT DISTINCT raw_query FROM jobs) JOIN dim_context ON {phrase(norm('raw_query'), 'term')} GROUP BY ALL)
    GROUP BY raw_query HAVING max(score) >= 1.0 AND max(score) - coalesce(list_sort(list(score), 'DESC')[2], 0) >= 0.5) v
    ON v.raw_query = j.raw_query""", ("jobs", "dim_pattern", "dim_context"))
_PLACE = norm("location")
cte("parsed_jobs", f"""
  SELECT job_id, job_family, min_years, max_years, contains({_PLACE}, 'remote') AS is_remote,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PLACE}, '{_PAREN}', ' ', 'g'),
      '\\b(remote|hybrid|on-site|onsite|india)\\b', ' ', 'g'), '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g')) AS city
  FROM job_class""", ("job_class",))
cte("job_req", f"""
  SELECT l.job_id, l.lst, l.pos, r.* FROM (
    SELECT job_id, 'must' AS lst, unnest(range(1, len(must_have) + 1)) AS pos, unnest(must_have) AS raw FROM jobs
    UNION ALL SELECT job_id, 'good', unnest(range(1, len(good_to_have) + 1)), unnest(good_to_have) FROM jobs) l
  JOIN ({sql_requirements('SELECT DISTINCT unnest(list_concat(must_have, good_to_have)) AS raw FROM jobs')}) r USING (raw)""",
    ("jobs", "dim_concept", "alias"))


@shared
def jobs(spark, sf):
    return materialised(rq.parse_jobs(demo.jobs(spark, sf), RULES), "jobs")


@query("job_class", "SELECT job_id, job_family, is_remote, city FROM parsed_jobs", ("parsed_jobs",))
def job_class(spark, sf):
    return jobs(spark, sf).select("job_id", "job_family", "is_remote", "city")


@query("pairs_subset", """
  SELECT c_custkey AS id, 'wanted' AS lane FROM customer WHERE c_custkey IN (SELECT o_custkey * 2 FROM orders)
  UNION ALL SELECT DISTINCT o_custkey * 2, 'unknown' FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)""")
def pairs_subset(spark, sf):
    people = demo.bare_people(spark, sf)
    wanted = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("id")).distinct()
    found, unknown = sc.pair_subset(people, wanted)
    return found.select("id", F.lit("wanted").alias("lane")).unionByName(
        unknown.select("id", F.lit("unknown").alias("lane")))


# --------------------------------------------------------------- shipped work
_SHIPS = (f"({any_phrase(norm('description'), fv.OWNERSHIP_VERBS)} OR "
          f"regexp_matches({norm('description')}, '[0-9]'))")
cte("shipped", f"""
  SELECT id, substr(trim(arg_min(description, ix) FILTER ({_SHIPS})), 1, 80) AS snippet FROM entries GROUP BY id""",
    ("entries",))
cte("term_hits", f"""
  SELECT DISTINCT e.id, t.term FROM (SELECT DISTINCT id, description FROM entries WHERE description IS NOT NULL) e
  JOIN (SELECT DISTINCT unnest(terms) AS term FROM job_req) t ON contains({norm('e.description')}, t.term)""",
    ("entries", "job_req"))


@shared
def shipped(spark, sf):
    return sc.shipped_evidence(demo.orders_as_entries(spark, sf), sc.job_terms(jobs(spark, sf)))


@query("score_evidence", f"""
  SELECT s.id, s.snippet, coalesce(t.hits, '') AS hits FROM shipped s LEFT JOIN (
    SELECT id, array_to_string(list_sort(list(term)), '|') AS hits FROM term_hits GROUP BY id) t USING (id)""",
       ("shipped", "term_hits"))
def score_evidence(spark, sf):
    return shipped(spark, sf).select("id", "snippet", F.array_join(
        F.array_sort("term_hits"), "|").alias("hits"))


# ---------------------------------------------------------------------- pairs
_RUNGS = values([(r, *[1 if s in on else 0 for s in sc.SWITCHES]) for r, on in sc.RUNGS.items()])
cte("dim_rung", "SELECT * FROM (VALUES " + _RUNGS + ") t(rung, " + ", ".join(f"f_{s}" for s in sc.SWITCHES) + ")")
cte("pair_base", f"""
  SELECT s.id, j.job_id, s.role_family, s.priors, s.core_skills, s.claimed, s.switch_intent, s.tenure_flag,
    s.confidence, {norm('p.location')} AS place, h.snippet, j.job_family, j.min_years, j.max_years, j.city, j.is_remote,
    {sql_adj('s.role_family', 'j.job_family', 's.priors')} / 1000000.0::DOUBLE AS direct
  FROM signals s JOIN people p USING (id) LEFT JOIN shipped h USING (id) CROSS JOIN parsed_jobs j""",
    ("signals", "people", "shipped", "parsed_jobs", "dim_adj"))
cte("pair_alt", f"""
  SELECT id, job_id, max({sql_adj('alt_f', 'job_family', 'priors')}) / 1000000.0::DOUBLE AS alt_best FROM (
    SELECT s.id, s.priors, j.job_id, j.job_family, unnest(s.role_family_alt) AS alt_f FROM signals s CROSS JOIN parsed_jobs j)
  GROUP BY id, job_id""", ("signals", "parsed_jobs", "dim_adj"))
cte("pair_years", f"""
  SELECT id, job_id, {rx('y', 2)} AS years FROM (SELECT s.id, j.job_id, sum(s.months *
    {sql_adj('s.family', 'j.job_family', 'r.priors')}) / 12000000.0::DOUBLE AS y
    FROM class_scores s JOIN resolved r USING (id) CROSS JOIN parsed_jobs j GROUP BY s.id, j.job_id)""",
    ("class_scores", "resolved", "parsed_jobs", "dim_adj"))
cte("pairs", """
  SELECT b.*, coalesce(a.alt_best, 0.0::DOUBLE) AS alt_best, coalesce(y.years, 0.0::DOUBLE) AS years
  FROM pair_base b LEFT JOIN pair_alt a USING (id, job_id) LEFT JOIN pair_years y USING (id, job_id)""",
    ("pair_base", "pair_alt", "pair_years"))


@shared
def candidates(spark, sf):
    cands = sc.candidates(signals(spark, sf), shipped(spark, sf))
    # What a ranking row repeats is found once per candidate, not per pair.
    carried = F.array_join(sc.carried_codes(F.col("reason_codes")), "|").alias("carried")
    return materialised(cands.select("*", carried).drop("reason_codes"), "candidates")


@query("score_affinity", "SELECT id, job_id, direct, alt_best FROM pairs", ("pairs",))
def score_affinity(spark, sf):
    rows = sc.beside_demands(candidates(spark, sf), jobs(spark, sf).select("job_id", "job_family"), ["job_family"],
                             lambda df: sc.affinity(df, RULES.adjacency))
    return rows.select("id", "job_id", "direct", "alt_best")


cte("covered", """
  SELECT p.id, p.job_id, d.rung, r.lst, r.pos, r.raw, CASE WHEN kind = 'evidence' THEN
      CASE WHEN coalesce(p.snippet, '') <> '' AND ((CASE WHEN d.f_role_prefilter = 1 THEN greatest(direct, alt_best * 0.6::DOUBLE) ELSE 1.0 END) >= 0.5
        OR EXISTS (SELECT 1 FROM term_hits t WHERE t.id = p.id AND list_contains(r.terms, t.term))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    WHEN list_has_any(r.alternatives, p.core_skills) THEN 1.0::DOUBLE
    WHEN list_has_any(r.alternatives, p.claimed) THEN CASE WHEN d.f_evidence_tiering = 1 AND r.lst = 'must' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END
    ELSE 0.0::DOUBLE END AS cover
  FROM pairs p CROSS JOIN dim_rung d JOIN job_req r USING (job_id)""",
    ("pairs", "dim_rung", "job_req", "term_hits"))
cte("overlap", """
  SELECT id, job_id, rung, coalesce(list_reduce(list_prepend(0.0::DOUBLE, list(cover ORDER BY pos) FILTER (lst = 'must')), lambda a, b: a + b)
      / count(*) FILTER (lst = 'must') * 18, 0) + coalesce(list_reduce(list_prepend(0.0::DOUBLE, list(cover ORDER BY pos) FILTER (lst = 'good')), lambda a, b: a + b)
      / count(*) FILTER (lst = 'good') * 7, 0) AS points,
    list(raw ORDER BY pos) FILTER (lst = 'must' AND cover = 0) AS missing,
    array_to_string(list(CAST(cover AS VARCHAR) ORDER BY pos) FILTER (lst = 'must'), '|') AS must,
    array_to_string(list(CAST(cover AS VARCHAR) ORDER BY pos) FILTER (lst = 'good'), '|') AS good
  FROM covered GROUP BY id, job_id, rung""", ("covered",))


def beside_cover(spark, sf, show):
    """Every candidate beside every job with the columns that ``show`` makes from their cover, once for jobs that ask the same."""
    def cover(df):
        df = sc.affinity(df, RULES.adjacency)
        df = df.withColumn("affinity", F.greatest(F.col("direct"), F.col("alt_best") * fv.ALTERNATE_AFFINITY))
        df = df.withColumns({"m": sc.coverage("must_have", "affinity", sc.switches()),
                             "g": sc.coverage("good_to_have", "affinity", sc.switches())})
        df = df.withColumn("mc", F.transform("m", lambda m: F.when(
            m["claimed_only"], fv.CLAIMED_ONLY_CREDIT).otherwise(m["cover"])))
        return df.select("id", *[c.alias(n) for n, c in show.items()], "_jobs")

    asked = jobs(spark, sf).select("job_id", *sc.DEMAND)
    return sc.beside_demands(candidates(spark, sf), asked, sc.DEMAND, cover).select("id", "job_id", *show)


@query("score_requirements", "SELECT id, job_id, must, good FROM overlap WHERE rung = 4", ("overlap",))
def score_requirements(spark, sf):
    return beside_cover(spark, sf, {
        "must": F.array_join(F.transform("mc", lambda c: c.cast("string")), "|"),
        "good": F.array_join(F.transform("g", lambda g: g["cover"].cast("string")), "|")})


@query("score_overlap", f"""
  SELECT id, job_id, {rx('points', 2)} AS points, coalesce(array_to_string(missing, '|'), '') AS missing
  FROM overlap WHERE rung = 4""", ("overlap",))
def score_overlap(spark, sf):
    points = sc.mean_points(F.col("mc"), fv.MUST_POINTS) + sc.mean_points(
        F.transform("g", lambda g: g["cover"]), fv.GOOD_POINTS)
    missing = F.transform(F.filter("m", lambda m: m["cover"] < 1), lambda m: m["raw"])
    return beside_cover(spark, sf, {"points": round_exact(points, 2), "missing": F.array_join(missing, "|")})


def sql_band(y: str, lo: str, hi: str) -> str:
    dist = f"(CASE WHEN {y} < {lo} THEN {lo} - {y} ELSE {y} - {hi} END)"
    return (f"(CASE WHEN {y} BETWEEN {lo} AND {hi} THEN 15.0::DOUBLE WHEN {dist} <= 1.0 THEN 9.0::DOUBLE "
            f"ELSE greatest(0.0::DOUBLE, 9.0::DOUBLE * (1.0::DOUBLE - ({dist} - 1.0::DOUBLE) / 3.0::DOUBLE)) END)")


@query("score_band", f"""
  SELECT c_custkey, job_id, {rx('p', 2)} AS points FROM (SELECT c_custkey, job_id,
    {sql_band('y', 'min_years', 'max_years')} AS p FROM (SELECT c_custkey, c_acctbal / 1000 AS y FROM customer) CROSS JOIN jobs)""", ("jobs",))
def score_band(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 1000).alias("y"))
    both = sc.pairs(rows, demo.jobs(spark, sf).select("job_id", "min_years", "max_years"))
    return both.select("c_custkey", "job_id", round_exact(sc.band_points(
        F.col("y"), F.col("min_years"), F.col("max_years")), 2).alias("points"))


_METRO = " OR ".join(f"(regexp_matches(city, '{'|'.join(c)}') AND regexp_matches(place, '{'|'.join(c)}'))"
                     for c in fv.METROS.values())
_WHERE = ("CASE WHEN is_remote THEN 'remote' WHEN city <> '' AND contains(place, city) THEN 'exact' "
          f"WHEN city <> '' AND place <> '' AND ({_METRO}) THEN 'metro' ELSE 'other' END")


@query("score_location", f"""
  SELECT c_custkey, n_nationkey, {_WHERE} AS kind FROM (SELECT c_custkey, n_nationkey, lower(n_name) AS city,
      lower(o.n || ' of ' || r_name) AS place, n_nationkey % 6 = 0 AS is_remote
    FROM customer JOIN (SELECT n_nationkey AS k, n_name AS n, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) o ON k = c_nationkey
    CROSS JOIN nation)""".replace(_METRO, "FALSE"))
def score_location(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("k"), F.lower(F.concat("n_name", F.lit(" of "), "r_name")).alias("place"))
    placed = table(spark, sf, "customer").join(home, F.col("c_nationkey") == F.col("k")).select("c_custkey", "place")
    rows = sc.pairs(placed, nation.select("n_nationkey", "n_name"))
    return rows.select("c_custkey", "n_nationkey", sc.location_kind(
        F.lower("n_name"), F.col("n_nationkey") % 6 == 0, F.col("place")).alias("kind"))


_PARTS = {
    "role_match": "(30 * affinity)",
    "skill_overlap": "(CASE WHEN f_must_have_scoring = 1 THEN points ELSE 0.0::DOUBLE END)",
    "seniority_fit": f"(CASE WHEN f_seniority_band = 1 THEN {sql_band('years', 'min_years', 'max_years')} ELSE 0.0::DOUBLE END)",
    "evidence_of_shipping": "(CASE WHEN f_evidence_of_shipping = 1 AND coalesce(snippet, '') <> '' THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END)",
    "location_fit": f"(CASE WHEN f_location_fit = 1 THEN CASE {_WHERE} WHEN 'remote' THEN 8.0::DOUBLE WHEN 'exact' THEN 8.0::DOUBLE WHEN 'metro' THEN 5.0::DOUBLE ELSE 2.0::DOUBLE END ELSE 0.0::DOUBLE END)",
    "switch_intent": "(CASE WHEN f_switch_intent = 1 THEN switch_intent * 5 ELSE 0.0::DOUBLE END)",
    "tenure_stability": "(CASE WHEN f_tenure_stability = 1 THEN CASE tenure_flag WHEN 'stable' THEN 1.0::DOUBLE WHEN 'hopper' THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END * 5 ELSE 0.0::DOUBLE END)",
}
cte("scored", f"""
  SELECT *, {rx('t1', 6)} AS total FROM (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE,
      CASE WHEN f_soft_cap = 1 AND affinity = 0 AND t0 > 35 THEN 35.0::DOUBLE ELSE t0 END)) AS t1
    FROM (SELECT *, {" + ".join(f"c_{n}" for n in _PARTS)} - 8 * n_missing AS t0 FROM (
      SELECT *, {", ".join(f"{rx('r_' + n, 2)} AS c_{n}" for n in _PARTS)} FROM (
        SELECT *, {", ".join(f"{e} AS r_{n}" for n, e in _PARTS.items())} FROM (
          SELECT p.*, d.*, o.points, CASE WHEN f_must_have_scoring = 1 THEN coalesce(len(o.missing), 0) ELSE 0 END AS n_missing,
            CASE WHEN f_must_have_scoring = 1 THEN coalesce(array_to_string(o.missing, '|'), '') ELSE '' END AS missing,
            CASE WHEN f_role_prefilter = 1 THEN greatest(direct, alt_best * 0.6::DOUBLE) ELSE 1.0::DOUBLE END AS affinity
          FROM pairs p CROSS JOIN dim_rung d LEFT JOIN overlap o USING (id, job_id, rung))))))""",
    ("pairs", "dim_rung", "overlap"))


@shared
def scored(spark, sf):
    """What rankings show of a pair; the lists of candidates and jobs and the codes of a match stay behind."""
    return sc.score_pairs(candidates(spark, sf), jobs(spark, sf), RULES).select(
        "id", "job_id", "score_breakdown", "missing_must_haves", "total", "fit_score", "confidence", "carried")


@query("fit_score", "SELECT id, job_id, " + ", ".join(f"c_{n} AS {n}" for n in _PARTS)
       + ", missing, total, CAST(round_even(total, 0) AS BIGINT) AS fit_score FROM scored WHERE rung = 4", ("scored",))
def fit_score(spark, sf):
    return scored(spark, sf).select("id", "job_id", *[F.col(f"score_breakdown.{n}").alias(n) for n in _PARTS],
                                    F.array_join("missing_must_haves", "|").alias("missing"), "total", "fit_score")


_CARRY = " OR ".join(f"starts_with(c, '{p}')" for p in fv.CARRIED_CODES)


@query("rank_matches", f"""
  SELECT r.id, r.job_id, row_number() OVER (PARTITION BY r.job_id ORDER BY r.total DESC, r.confidence DESC, r.id) AS rank,
    CAST(round_even(r.total, 0) AS BIGINT) AS fit_score, r.total, r.confidence,
    array_to_string(list_filter(s.codes, lambda c: {_CARRY}), '|') AS carried
  FROM scored r JOIN signals s USING (id) WHERE rung = 4""", ("scored", "signals"))
def rank_matches(spark, sf):
    rows = scored(spark, sf).select("id", "job_id", "fit_score", "total", "confidence", "carried")
    return sc.rank_matches(rows, ["job_id"]).select(
        "id", "job_id", "rank", "fit_score", "total", "confidence", "carried")


@query("topk_per_group", """
  SELECT id, job_id, rank, total FROM (SELECT id, job_id, total, row_number() OVER (PARTITION BY job_id
    ORDER BY total DESC, confidence DESC, id) AS rank FROM scored WHERE rung = 4) WHERE rank <= 8""", ("scored",))
def topk_per_group(spark, sf):
    rows = scored(spark, sf).select("id", "job_id", "total", "confidence")
    best = top_k(rows, ["job_id"], [F.desc("total"), F.desc("confidence"), F.col("id")], 8)
    return best.select("id", "job_id", "rank", "total")


def _dcg_sql(order: str) -> str:
    return (f"SELECT rung, job_id, sum((pow(2, rel) - 1) / log2(rn + 1)) AS d FROM (SELECT rung, job_id, rel, row_number() OVER "
            f"(PARTITION BY rung, job_id ORDER BY {order}) AS rn FROM graded) WHERE rn <= 10 GROUP BY rung, job_id")


@query("ablation_rungs", f"""
  , graded AS (SELECT rung, job_id, id, total, confidence, (id * 7 + job_id * 13) % 4 AS rel FROM scored),
  per AS (SELECT a.rung, a.job_id, CASE WHEN i.d = 0 THEN 0 ELSE a.d / i.d END AS ndcg FROM ({_dcg_sql('total DESC, confidence DESC, id')}) a
    JOIN ({_dcg_sql('rel DESC')}) i USING (rung, job_id))
  SELECT rung, ndcg, {rx('(ndcg - lag(ndcg) OVER (ORDER BY rung))', 4)} AS delta
  FROM (SELECT rung, {rx('avg(ndcg)', 4)} AS ndcg FROM per GROUP BY rung)""", ("scored",))
def ablation_rungs(spark, sf):
    rungs = F.array(*[F.struct(F.lit(r).alias("rung"), sc.switches(on).alias("on"))
                      for r, on in sc.RUNGS.items()])
    rows = candidates(spark, sf).withColumn("r", F.explode(rungs)).select("*", F.col("r.rung").alias("rung"), F.col("r.on").alias("on")).drop("r")
    rows = sc.score_pairs(rows, jobs(spark, sf), RULES, F.col("on"))
    graded = rows.select("rung", "job_id", "id", "total", "confidence",
                         ((F.col("id") * 7 + F.col("job_id") * 13) % 4).alias("rel"))
    # Scores are costly, and two orders read them.
    graded = materialised(graded, "graded")
    key = ["rung", "job_id"]
    best = top_k(graded, key, [F.desc("total"), F.desc("confidence"), F.col("id")], 10, "position")
    dcg = best.groupBy(*key).agg(ev.dcg(F.col("rel"), F.col("position"), 10).alias("d"))
    both = dcg.join(ev.ideal_dcg(graded, [10], key), key)
    ndcg = F.when(F.col("ideal_10") == 0, 0.0).otherwise(F.col("d") / F.col("ideal_10"))
    per = both.groupBy("rung").agg(round_exact(F.avg(ndcg), 4).alias("ndcg"))
    # Four rows from here on.
    before = F.lag("ndcg").over(Window.partitionBy(F.lit(0)).orderBy("rung"))
    return per.select("rung", "ndcg", round_exact(F.col("ndcg") - before, 4).alias("delta"))


@query("cosine_rank", f"""
  SELECT query, vec_id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank
  FROM (SELECT c.label AS query, vec_id, {rx('list_sum(list_transform(range(1, len(u) + 1), lambda i: u[i] * centroid[i]))', 6)} AS similarity
    FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
      FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)), centroids c)""",
       ("centroids",))
def cosine_rank(spark, sf):
    vectors = table(spark, sf, "embeddings")
    queries = cl.centroids(vectors, "label", "embedding").select(
        F.col("label").alias("query"), F.col("centroid").alias("vector"))
    return sc.cosine_rank(vectors, queries, "vec_id", "embedding")


@query("driving_component", """
  SELECT id, job_id, list_extract(list_sort([""" + ", ".join(
    f"{{'g': -({float(fv.WEIGHTS[n])}::DOUBLE - c_{n}), 'o': {i}, 'n': '{n}'}}" for i, n in enumerate(_PARTS)) + """]), 1).n AS component
  FROM scored WHERE rung = 4""", ("scored",))
def driving_component(spark, sf):
    """The component that keeps each pair furthest from its full points."""
    maxima = {n: fv.WEIGHTS[n] for n in _PARTS}
    return scored(spark, sf).select("id", "job_id", ev.driving_component(F.col("score_breakdown"), maxima).alias("component"))
