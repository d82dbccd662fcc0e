"""Fit of every entity to every job: bounded components, reasons, total and rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import text as tx
from matchloom.functions.numeric import clamp, let, round_exact
from matchloom.functions.phrases import hits
from matchloom.operators.adjacency import Adjacency, years_towards
from matchloom.operators.signals import Rules
from matchloom.operators.skew import beside_blocks, in_blocks, ranked
from matchloom.operators.values import per_value
from matchloom.session import materialised

# ---------------------------------------------------------------- fixed values
SWITCHES = ["role_prefilter", "must_have_scoring", "evidence_tiering", "seniority_band",
            "evidence_of_shipping", "location_fit", "switch_intent", "tenure_stability",
            "soft_cap"]
# Switches that are on at each rung of the ablation ladder, coarsest first.
RUNGS = {
    1: ["role_prefilter"],
    2: ["role_prefilter", "must_have_scoring"],
    3: ["role_prefilter", "must_have_scoring", "evidence_tiering"],
    4: SWITCHES,
}
# ------------------------------------------------------------ end fixed values


def switches(on: list[str] | None = None) -> Column:
    on = SWITCHES if on is None else on
    return F.struct(*[F.lit(s in on).alias(s) for s in SWITCHES])


# --------------------------------------------------------- shipped evidence
#: Terms that are held in memory at most (a few dozen MB).
HELD_TERMS = 100_000


def shows_ownership(normed: Column) -> Column:
    """An ownership verb or a number: work that was delivered, not just attended."""
    return tx.has_any_phrase(normed, fv.OWNERSHIP_VERBS) | normed.rlike(r"(?U)\d")


def shipped_evidence(entries: DataFrame, terms: DataFrame, by: str = "id", ix: str = "ix") -> DataFrame:
    """First evidencing snippet per entity, and which ``term``s its history mentions.

    A term is one word and is mentioned where a description's word holds it.  Up
    to ``HELD_TERMS`` terms stand in an automaton beside every task, which reads a
    description once for all of them; beyond that, distinct words meet the terms
    through their own substrings of the lengths that terms have, in an equi-join.
    """
    held = sorted(r.term for r in terms.where("term <> ''").select("term").distinct().limit(HELD_TERMS + 1).collect())
    few_terms = len(held) <= HELD_TERMS

    def read(df: DataFrame) -> DataFrame:
        df = df.withColumn("_d", tx.norm_text(F.col("description")))
        # Only the shown snippet is cut; the tests read the whole text.
        df = df.withColumns({"_owns": shows_ownership(F.col("_d")), "_shown": F.substring(F.trim("description"), 1, 80)})
        return df.withColumn("_places", hits(F.col("_d"), held, whole_words=False)) if few_terms else df

    # Descriptions that repeat are read once each.
    rows = per_value(entries.select(by, ix, "description"), ["description"], read)
    first = rows.groupBy(by).agg(F.min_by(F.when(F.col("_owns"), F.col("_shown")), F.when(F.col("_owns"), F.col(ix))).alias("snippet"))
    found = _held_terms(rows, held, by) if few_terms else _joined_terms(rows, terms, by)
    return first.join(found, by, "left").withColumn(
        "term_hits", F.coalesce("term_hits", F.array().cast("array<string>")))


def _held_terms(rows: DataFrame, terms: list[str], by: str) -> DataFrame:
    """Terms per entity, from their ``_places`` in the list of terms."""
    # Each place once per entity and task before the shuffle.
    own = rows.where("_d <> ''").select(by, F.explode("_places").alias("_place")).groupBy(by).agg(F.collect_set("_place").alias("_own"))
    names = F.lit(terms).cast("array<string>")
    return own.select(by, F.transform("_own", lambda i: F.get(names, i)).alias("term_hits"))


def _joined_terms(rows: DataFrame, terms: DataFrame, by: str) -> DataFrame:
    """Terms per entity where there are too many terms to hold: words meet them through their substrings."""
    words = rows.select(by, F.explode(F.array_distinct(F.split("_d", " "))).alias("_word")).where("_word <> ''").distinct()
    # A digest stands for the word beside its parts, as a word may be long.
    words = words.select(by, "_word", F.sha2("_word", 256).alias("_key"))
    terms = terms.select("term").distinct()
    lengths = terms.select(F.length("term").alias("_n")).where("_n > 0").distinct()
    starts = F.sequence(F.lit(1), F.length("_word") - F.col("_n") + 1)
    known = words.select("_word", "_key").distinct().join(F.broadcast(lengths), F.length("_word") >= F.col("_n")).select(
        "_key", F.explode(F.transform(starts, lambda i: F.substring(F.col("_word"), i, F.col("_n")))).alias("term"))
    held = known.join(terms, "term").distinct()
    return words.select(by, "_key").join(held, "_key").groupBy(by).agg(F.collect_set("term").alias("term_hits"))


def job_terms(jobs: DataFrame) -> DataFrame:
    """Distinct words of all evidence requirements as ``term``."""
    return jobs.select(F.explode(F.flatten(F.transform(
        F.concat("must_have", "good_to_have"), lambda r: r["terms"]))).alias("term")).distinct()


# ---------------------------------------------------------------- components
def affinity(df: DataFrame, adj: Adjacency) -> DataFrame:
    """Direct class affinity and the best of the alternates."""
    best = F.array_max(F.transform(
        "role_family_alt", lambda a: adj.score(a, F.col("job_family"), F.col("priors"))))
    return df.withColumn(
        "direct", adj.score(F.col("role_family"), F.col("job_family"), F.col("priors"))
    ).withColumn("alt_best", F.coalesce(best, F.lit(0.0)))


def coverage(requirements: str, affinity_col: str, on: Column) -> Column:
    """Per requirement: label, raw, coverage, claimed_only and the evidence shown."""
    def one(r: Column) -> Column:
        relevant = (F.col(affinity_col) >= fv.DOMAIN_AFFINITY) | F.arrays_overlap(
            r["terms"], F.col("term_hits"))
        proven = F.col("snippet").isNotNull() & (F.col("snippet") != "") & relevant
        core = F.arrays_overlap(r["alternatives"], F.col("core_skills"))
        named = F.arrays_overlap(r["alternatives"], F.col("claimed_skills_unverified"))
        is_evidence = r["kind"] == "evidence"
        met = F.when(is_evidence, proven).otherwise(core | named)
        return F.struct(
            r["label"].alias("label"), r["raw"].alias("raw"),
            F.when(met, 1.0).otherwise(0.0).alias("cover"),
            (~is_evidence & met & ~core).alias("claimed_only"),
            F.when(is_evidence & met, F.col("snippet")).alias("shown"))
    return F.transform(requirements, one)


def mean_points(covers: Column, points: float) -> Column:
    def mean(cs: Column) -> Column:
        total = F.aggregate(cs, F.lit(0.0), lambda acc, c: acc + c)
        return F.when(F.size(cs) > 0, total / F.size(cs) * points).otherwise(0.0)

    return let(covers, mean)


def band_points(years: Column, low: Column, high: Column) -> Column:
    """Full points in the band, near points within a year, then linear decay to 0."""
    def outside(distance: Column) -> Column:
        return F.when(distance <= fv.BAND_NEAR_YEARS, float(fv.BAND_NEAR)).otherwise(
            F.greatest(F.lit(0.0), F.lit(float(fv.BAND_NEAR)) * (
                1.0 - (distance - fv.BAND_NEAR_YEARS) / fv.BAND_DECAY_YEARS)))

    return let(years, lambda y: F.when(
        (y >= low) & (y <= high), float(fv.BAND_IN)).otherwise(
        let(F.when(y < low, low - y).otherwise(y - high), outside)))


def same_metro(a: Column, b: Column, metros: dict[str, list[str]] | None = None) -> Column:
    metros = fv.METROS if metros is None else metros
    out = F.lit(False)
    for cities in metros.values():
        any_city = "|".join(cities)
        out = out | (a.rlike(any_city) & b.rlike(any_city))
    return (a != "") & (b != "") & out


def location_kind(city: Column, remote: Column, place: Column) -> Column:
    return (
        F.when(remote, "remote")
        .when((city != "") & F.contains(place, city), "exact")
        .when(same_metro(city, place), "metro")
        .otherwise("other")
    )


def _shown_number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


# -------------------------------------------------------------------- pairs
#: Blocks of 64 jobs that are broadcast at most.
HELD_BLOCKS = 16


def pairs(signals: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every entity beside every job, whatever their classes: the jobs stand beside each row in blocks.

    A few small files of entities become many costly pairs, so entities are dealt
    out first, to as many tasks as there are shuffle partitions.
    """
    names = jobs.columns
    small, blocks = in_blocks(jobs, F.struct(*names), 64)
    tasks = int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signals = signals.repartition(tasks, F.xxhash64(*signals.columns))
    # About a thousand jobs are sent to the entities; more meet them in a shuffle.
    rows = beside_blocks(signals, F.broadcast(small), blocks, salts=1) if blocks <= HELD_BLOCKS else beside_blocks(
        signals, small, blocks)
    return rows.select(*signals.columns, F.inline("_items"))


#: What of a job decides class affinity, years and cover, and how many jobs that agree in it stand in one list.
DEMAND = ["job_family", "must_have", "good_to_have"]
HELD_JOBS = 256


def beside_demands(signals: DataFrame, jobs: DataFrame, demand: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every entity beside every job, with what ``derive`` adds from the columns of an entity and ``demand``.

    Jobs that agree in ``demand`` share what is derived: it is worked out once for
    an entity and a demand.  Longer lists of such jobs are cut.
    """
    rest = [c for c in jobs.columns if c not in demand]
    cuts = max(1, -(-jobs.count() // HELD_JOBS))
    cut = F.pmod(F.xxhash64(*rest), F.lit(cuts)).alias("_cut")
    kinds = jobs.groupBy(*demand, cut).agg(F.collect_list(F.struct(*rest)).alias("_jobs")).drop("_cut")
    rows = derive(pairs(signals, kinds))
    return rows.select(*[c for c in rows.columns if c != "_jobs"], F.inline("_jobs"))


def score_pairs(signals: DataFrame, jobs: DataFrame, rules: Rules, on: Column | None = None) -> DataFrame:
    """:func:`score` of every entity beside every job; ``on`` may follow from the entity's columns."""
    signals = signals.withColumn("_on", on if on is not None else switches())
    return _totals(beside_demands(signals, jobs, DEMAND, lambda df: _against_demand(df, rules)))


def score(df: DataFrame, rules: Rules, on: Column | None = None) -> DataFrame:
    """Adds components, codes, missing must-haves, total and fit score to pairs."""
    return _totals(_against_demand(df.withColumn("_on", on if on is not None else switches()), rules))


def _against_demand(df: DataFrame, rules: Rules) -> DataFrame:
    """Affinity, years and cover: all that follows from an entity and the ``DEMAND`` of a job."""
    adj = rules.adjacency
    df = affinity(df, adj)
    near = F.when(F.col("_on.role_prefilter"), F.greatest(
        F.col("direct"), F.col("alt_best") * fv.ALTERNATE_AFFINITY)).otherwise(1.0)
    df = df.withColumns({
        "affinity": near,
        "years_for_job": years_towards(F.col("history"), F.col("job_family"), F.col("priors"), adj)})
    df = df.withColumns({"_must": coverage("must_have", "affinity", F.col("_on")),
                         "_good": coverage("good_to_have", "affinity", F.col("_on"))})
    flag = {s: F.col(f"_on.{s}") for s in SWITCHES}
    tiered = flag["evidence_tiering"]
    must_cover = F.transform("_must", lambda m: F.when(
        m["claimed_only"] & tiered, fv.CLAIMED_ONLY_CREDIT).otherwise(m["cover"]))
    overlap = F.when(flag["must_have_scoring"], (
        mean_points(must_cover, fv.MUST_POINTS)
        + mean_points(F.transform("_good", lambda g: g["cover"]), fv.GOOD_POINTS))).otherwise(0.0)
    return df.withColumns({"_overlap": overlap, "missing_must_haves": F.when(flag["must_have_scoring"], F.transform(
        F.filter("_must", lambda m: m["cover"] < 1), lambda m: m["raw"])).otherwise(F.array().cast("array<string>"))})


def _totals(df: DataFrame) -> DataFrame:
    flag = {s: F.col(f"_on.{s}") for s in SWITCHES}
    df = df.withColumn("_where", location_kind(F.col("city"), F.col("is_remote"), F.col("location_text")))
    place_points = F.try_element_at(
        tx.literal_map({k: float(v) for k, v in fv.LOCATION_POINTS.items()}), F.col("_where"))
    steady = F.try_element_at(tx.literal_map(fv.TENURE_FACTORS), F.col("tenure_flag"))
    has_snippet = F.coalesce(F.col("snippet") != "", F.lit(False))
    parts = {
        "role_match": F.col("affinity") * fv.WEIGHTS["role_match"],
        "skill_overlap": F.col("_overlap"),
        "seniority_fit": F.when(flag["seniority_band"], band_points(
            F.col("years_for_job"), F.col("min_years"), F.col("max_years"))).otherwise(0.0),
        "evidence_of_shipping": F.when(
            flag["evidence_of_shipping"] & has_snippet,
            float(fv.WEIGHTS["evidence_of_shipping"])).otherwise(0.0),
        "location_fit": F.when(flag["location_fit"], place_points).otherwise(0.0),
        "switch_intent": F.when(flag["switch_intent"], F.col("switch_intent_p")
                                * fv.WEIGHTS["switch_intent"]).otherwise(0.0),
        "tenure_stability": F.when(flag["tenure_stability"], steady
                                   * fv.WEIGHTS["tenure_stability"]).otherwise(0.0),
    }
    df = df.withColumn("score_breakdown", F.struct(*[round_exact(p, 2).alias(n) for n, p in parts.items()]))

    def summed(breakdown: Column) -> Column:
        total = F.lit(0.0)
        for n in parts:
            total = total + breakdown[n]
        return total

    df = df.withColumn("_raw", let(F.col("score_breakdown"), summed)
                       - F.size("missing_must_haves") * fv.MISSING_PENALTY)
    may_cap = flag["soft_cap"] & (F.col("affinity") == 0)
    total = let(F.col("_raw"), lambda r: clamp(
        F.when(may_cap & (r > fv.MISMATCH_CAP), float(fv.MISMATCH_CAP)).otherwise(r), 0.0, 100.0))
    df = df.withColumns({"total": round_exact(total, 6),
                         "_capped": may_cap & (F.col("_raw") > fv.MISMATCH_CAP)})
    df = df.withColumns({"fit_score": F.rint("total").cast("bigint"),
                         "match_codes": _codes(flag, has_snippet)})
    return df.drop("_must", "_good", "_overlap", "_raw", "_where", "_capped")


def _codes(flag: dict[str, Column], has_snippet: Column) -> Column:
    years, low, high = F.col("years_for_job"), F.col("min_years"), F.col("max_years")
    shown = F.format_string("%.1f", round_exact(years, 1))
    role = (
        F.when(F.col("direct") >= 1, F.concat(F.lit("role_match:"), "job_family"))
        .when(F.col("affinity") > 0, F.concat(
            F.lit("role_adjacent:"), "role_family", F.lit("~"), "job_family", F.lit("="),
            F.format_string("%.2f", round_exact(F.col("affinity"), 2))))
        .otherwise(F.concat(F.lit("role_mismatch:"), "role_family", F.lit("!="), "job_family"))
    )
    must = F.transform("_must", lambda m: (
        F.when(m["claimed_only"] & flag["evidence_tiering"],
               F.concat(F.lit("must_have_claimed_only:"), m["label"]))
        .when((m["cover"] >= 1) & m["shown"].isNotNull(), F.concat(
            F.lit("must_have_met:"), m["label"], F.lit("|evidence="), m["shown"]))
        .when(m["cover"] >= 1, F.concat(F.lit("must_have_met:"), m["label"]))
        .otherwise(F.concat(F.lit("must_have_missing:"), m["label"]))))
    good = F.transform(F.filter("_good", lambda g: g["cover"] >= 1),
                       lambda g: F.concat(F.lit("good_to_have_met:"), g["label"]))
    none = F.array().cast("array<string>")
    band = (
        F.when((years >= low) & (years <= high), F.concat(
            F.lit("years_in_band:"), shown, F.lit(" in ["), _shown_number(low), F.lit(","),
            _shown_number(high), F.lit("]")))
        .when(years < low, F.concat(F.lit("years_below_min:"), shown, F.lit("<"),
                                    _shown_number(low)))
        .otherwise(F.concat(F.lit("years_above_max:"), shown, F.lit(">"), _shown_number(high)))
    )
    short = F.trim(F.regexp_extract("location_text", r"^([^,]*)", 1))
    where = (
        F.when(F.col("_where") == "remote", "location_remote_ok")
        .when(F.col("_where").isin("exact", "metro"), F.concat(F.lit("location_exact:"), "city"))
        .otherwise(F.concat(
            F.lit("location_mismatch:"), F.when(short != "", short).otherwise("unknown"),
            F.lit("vs"), F.when(F.col("city") != "", F.col("city")).otherwise("unknown")))
    )
    shipped = F.when(has_snippet, F.concat(F.lit("evidence_of_scale:"), "snippet")).otherwise(
        "no_production_ownership")
    return F.concat(
        F.array(role),
        F.when(flag["must_have_scoring"], F.concat(must, good)).otherwise(none),
        F.array_compact(F.array(
            F.when(flag["seniority_band"], band),
            F.when(flag["evidence_of_shipping"], shipped),
            F.when(flag["location_fit"], where),
            F.when(F.col("_capped"), f"score_capped_role_mismatch:{fv.MISMATCH_CAP}"))))


def carried_codes(codes: Column) -> Column:
    """Signal codes worth repeating on a ranking row."""
    def kept(code: Column) -> Column:
        out = F.lit(False)
        for prefix in fv.CARRIED_CODES:
            out = out | F.startswith(code, F.lit(prefix))
        return out
    return F.filter(codes, kept)


def candidates(signals: DataFrame, shipped: DataFrame) -> DataFrame:
    """Signals with the shipped evidence, columns narrowed to what scoring reads."""
    return signals.select(
        "id", "role_family", "role_family_alt", "priors", "history", "core_skills",
        "claimed_skills_unverified", F.col("switch_intent").alias("switch_intent_p"),
        "tenure_flag", "location_text", "confidence", "reason_codes",
    ).join(shipped, "id", "left").withColumn(
        "term_hits", F.coalesce("term_hits", F.array().cast("array<string>")))


def rank_matches(scored: DataFrame, group: list[str]) -> DataFrame:
    """Rank per job by total, confidence and id (of any type); no job's candidates meet in one task."""
    # Scores are costly, and ranges read them twice.
    return ranked(materialised(scored, "scored"), group, [F.desc("total"), F.desc("confidence"), F.col("id")])


def pair_subset(signals: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals of the wanted ids, wanted ids that do not exist)."""
    return (signals.join(wanted, "id", "left_semi"),
            wanted.join(signals.select("id"), "id", "left_anti"))


def cosine_rank(vectors: DataFrame, queries: DataFrame, by: str, vector: str, digits: int = 6) -> DataFrame:
    """Similarity of each vector to each query vector (``query``, ``vector``, of unit length), ranked per query."""
    from matchloom.functions import vectors as vec

    small, blocks = in_blocks(queries, F.struct("query", "vector"))
    unit = vectors.select(by, vec.unit(F.col(vector)).alias("_u"))
    rows = beside_blocks(unit, small, blocks).select(by, F.explode(F.transform("_items", lambda q: F.struct(
        q["query"].alias("query"),
        round_exact(vec.dot(F.col("_u"), q["vector"]), digits).alias("similarity"))))
        .alias("_s")).select(by, "_s.*")
    return ranked(materialised(rows, "similarities"), ["query"], [F.desc("similarity"), F.col(by)])
