"""The signal record: everything known about an entity, with reasons."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom import vocabulary as vocab
from matchloom.functions import dates as dt
from matchloom.functions import text as tx
from matchloom.functions.numeric import clamp, let, round_exact
from matchloom.operators import skills as sk
from matchloom.operators import spans as sp
from matchloom.operators.adjacency import Adjacency, years_towards
from matchloom.operators.classify import Lexicon, asks_context, classify, decided, title_stage
from matchloom.operators.values import per_value
from matchloom.session import materialised


@dataclass
class Rules:
    lexicon: Lexicon = field(default_factory=Lexicon)
    adjacency: Adjacency = field(default_factory=Adjacency)
    aliases: dict[str, str] = field(default_factory=vocab.alias_map)
    families: list[str] = field(default_factory=lambda: list(fv.FAMILIES))
    half_life: float = fv.HALF_LIFE_MONTHS
    version: str = fv.SIGNALS_VERSION


# ------------------------------------------------------------------- levels
def title_level(normed: Column) -> Column:
    """Level a title states outright: manager words first, then staff words."""
    return (
        F.when(tx.has_any_phrase(normed, fv.MANAGER_TITLES), "manager")
        .when(tx.has_any_phrase(normed, fv.STAFF_TITLES), "staff+")
    )


def claimed_level(normed_headline: Column) -> Column:
    picked = None
    for pattern, level in fv.HEADLINE_LEVELS:
        test = normed_headline.rlike("(?U)" + pattern)
        picked = F.when(test, level) if picked is None else picked.when(test, level)
    return picked


def level_from_years(years: Column, intern_only: Column) -> Column:
    return let(years, lambda y: (
        F.when(intern_only | (y < 1), "intern")
        .when(y < 3, "junior").when(y < 6, "mid").otherwise("senior")))


def level_order(level: Column) -> Column:
    return F.try_element_at(tx.literal_map(fv.LEVEL_ORDER), level)


# ------------------------------------------------------------------- intent
def intent_terms(open_to_work: Column, seeking: Column, on_break: Column, role_text: Column, current: Column,
                 avg: Column, tenure_flag: Column) -> dict[str, Column]:
    """Which intent terms hold, in weight-table order."""
    return {
        "open_to_work": F.coalesce(open_to_work, F.lit(False)),
        "seeking_language": seeking,
        "career_break": on_break,
        "overdue_for_a_move": (avg > 0) & (current > avg * 1.5) & (current > 36),
        "hopper": tenure_flag == "hopper",
        "freelance_or_contract": role_text.rlike(_bounded(fv.FREELANCE_PHRASES)),
        "just_started": (current > 0) & (current < 12),
        "founder_or_self_employed": role_text.rlike(_bounded(fv.FOUNDER_PHRASES)),
    }


def _bounded(phrases: list[str]) -> str:
    return r"(?U)\b(" + "|".join(phrases) + r")\b"


def intent_probability(terms: dict[str, Column]) -> Column:
    """Unrounded logistic of the base plus the weights of the terms that hold."""
    z = reduce(lambda acc, name: acc + F.when(terms[name], fv.INTENT_WEIGHTS[name]).otherwise(0.0),
               fv.INTENT_WEIGHTS, F.lit(0.0)) + fv.INTENT_BASE
    return 1.0 / (1.0 + F.exp(-z))


def intent_band(p: Column) -> Column:
    return F.when(p < fv.INTENT_LOW, "low").when(p < fv.INTENT_HIGH, "medium").otherwise("high")


# --------------------------------------------------------------- confidence
def confidence(flags: dict[str, Column], noise: Column) -> Column:
    """Product of the penalties of the flags that hold; noise is scaled above one half."""
    value = F.lit(1.0)
    for flag in sorted(flags):
        penalty = F.lit(fv.CONFIDENCE_PENALTIES[flag])
        if flag == "high_skill_noise":
            penalty = penalty * F.when(noise <= 0.5, 0.0).otherwise(
                F.least(F.lit(1.0), (noise - 0.5) / 0.5))
        value = value * F.when(flags[flag], 1.0 - penalty).otherwise(1.0)
    return round_exact(clamp(value, fv.CONFIDENCE_FLOOR, fv.CONFIDENCE_CEILING), 3)


def flag_list(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(flags[f], F.lit(f)) for f in sorted(flags)]))


# ------------------------------------------------------------------ entries
def classified_entries(entries: DataFrame, as_of: Column, rules: Rules,
                       fallbacks: list[Column] | None = None) -> DataFrame:
    """Entries with spans, class and level words; no row is shuffled.

    Titles that repeat are read once each (:func:`per_value`), and a context only
    where the title asks for it.
    """
    spans = sp.resolve_spans(entries, as_of)

    def titles(df: DataFrame) -> DataFrame:
        df = df.withColumn("role_text", tx.norm_text(F.col("role")))
        df = df.withColumns({"core": tx.norm_title(F.col("role_text"))["core"], "level": title_level(F.col("role_text"))})
        return title_stage(df, "core", rules.lexicon)

    usable = F.col("start_on").isNotNull()
    work = F.concat_ws(" ", tx.blank_if_null(F.col("description")),
                       F.array_join(F.coalesce("skills_used", F.array().cast("array<string>")), " "))
    asked = F.lit(True) if fallbacks else usable & asks_context("core")
    ready = per_value(spans, ["role"], titles).withColumn("context", tx.norm_text(F.when(asked, work)))
    kept = [*spans.columns, "role_text", "core", "level"]
    out = decided(ready, kept, "core", "context", "cls", rules.lexicon, fallbacks)
    return out.withColumns({
        "cls": F.when(usable, F.col("cls")),
        "age": F.when(usable, dt.entry_age(F.col("end_on"), F.col("is_open"), as_of))})


def weighted_entries(entries: DataFrame, as_of: Column, rules: Rules,
                     fallbacks: list[Column] | None = None) -> DataFrame:
    """Classified entries with attributed months and their class contribution.

    ``months_covered``, the months of the union of an entity's spells, stands at one of its entries.
    """
    known = classified_entries(entries, as_of, rules, fallbacks)
    # Only spells that keep months come back from the sweep; it reads no text.
    kept = sp.longest_spells(sp.resolve_spans(entries, as_of)).select(
        F.col("_by").alias("id"), F.col("_ix").alias("ix"), "attributed", F.col("_covered").alias("months_covered"))
    joined = known.join(kept, ["id", "ix"], "left").withColumn(
        "attributed", F.when(F.col("start_on").isNotNull(), F.coalesce("attributed", F.lit(0)).cast("bigint")))
    score = (F.col("attributed").cast("double") * dt.decay(F.col("age"), rules.half_life)
             * F.col("cls.confidence"))
    return joined.withColumn("contribution", score)


# ----------------------------------------------------------------- features
def entity_features(weighted: DataFrame, as_of: Column, rules: Rules) -> DataFrame:
    """One aggregation per entity: class scores, months, tenure, levels and flags.

    Classes are a closed list, so their sums are plain conditional sums and the
    shuffle carries one partial row per entity and map task.
    """
    fam = F.col("cls.family")
    usable = F.col("start_on").isNotNull()
    is_open = usable & F.col("is_open")
    latest = F.struct((-F.unix_date("end_on")).alias("ne"), "ix")
    kind = F.lower(F.trim(tx.blank_if_null(F.col("job_type"))))
    aggs = [
        *[F.sum(F.when(fam == f, F.col("contribution"))).alias(f"_s_{f}") for f in rules.families],
        *[F.sum(F.when(fam == f, F.col("attributed"))).alias(f"_m_{f}") for f in rules.families],
        *[c.alias(n) for n, c in sp.tenure_columns(as_of).items()],
        F.count(F.lit(1)).alias("n_entries"),
        F.coalesce(F.sum(F.when(usable, F.col("months"))), F.lit(0)).alias("n_months"),
        *([F.max("months_covered").alias("months_covered")] if "months_covered" in weighted.columns else []),
        F.coalesce(F.max(F.when(is_open, F.col("months"))), F.lit(0)).alias("current_months"),
        F.min_by(F.struct("role", "company_name", "job_type"), F.when(is_open, F.col("ix")))
        .alias("_current"),
        F.min_by("level", F.when(is_open & F.col("level").isNotNull(), F.col("ix")))
        .alias("_open_level"),
        F.max(is_open).alias("_any_open"),
        F.min_by(F.struct("level"), F.when(usable, latest)).alias("_latest"),
        F.bool_and(kind.isin("internship", "intern")).alias("intern_only"),
        F.bool_or("bad_date").alias("date_parse_failure"),
        F.bool_or(usable & F.col("off_length")).alias("duration_mismatch"),
        F.bool_or(usable & F.col("cls").isNull()).alias("unclassified_entries"),
        F.bool_or(F.coalesce(F.col("cls.source") != "lexicon", F.lit(False)))
        .alias("fallback_classifier_used"),
        F.min_by("cls.source", F.when(F.col("cls.source") != "lexicon", F.col("ix")))
        .alias("_fallback"),
        F.bool_and(tx.squeeze(tx.blank_if_null(F.col("description"))) == "")
        .alias("no_experience_descriptions"),
    ]
    rolled = weighted.groupBy("id").agg(*aggs)
    scored = F.filter(
        F.array(*[F.struct((-F.col(f"_s_{f}")).alias("neg"), F.lit(i).alias("ord"),
                           F.lit(f).alias("family")) for i, f in enumerate(rules.families)]),
        lambda s: s["neg"].isNotNull())
    history = F.filter(
        F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"_m_{f}").alias("months"))
                  for f in rules.families]),
        lambda m: m["months"].isNotNull())
    return _resolved(rolled.withColumns({
        "ranking": F.sort_array(scored), "history": history,
        "priors": F.transform(history, lambda h: h["family"])}))


def _resolved(df: DataFrame) -> DataFrame:
    """Primary class, alternates and the rounded score map from the ranking."""
    top = F.try_element_at(F.col("ranking"), F.lit(1))
    strong = top.isNotNull() & (top["neg"] < 0)
    rest = F.slice("ranking", 2, 2**30)
    near = F.filter(rest, lambda s: s["neg"] <= top["neg"] * fv.ALT_RATIO)
    return df.withColumns({
        "role_family": F.when(strong, top["family"]).otherwise(fv.DEFAULT_FAMILY),
        "role_family_alt": F.when(strong, F.slice(
            F.transform(near, lambda s: s["family"]), 1, fv.MAX_ALTERNATES))
        .otherwise(F.array().cast("array<string>")),
        "role_family_scores": F.map_from_entries(F.transform(
            "ranking", lambda s: F.struct(s["family"], round_exact(-s["neg"], 2)))),
    })


# ------------------------------------------------------------------- record
def extract(
    people: DataFrame, entries: DataFrame | None, as_of: Column, rules: Rules | None = None,
    education: DataFrame | None = None, fallbacks: list[Column] | None = None,
    weighted: DataFrame | None = None,
) -> DataFrame:
    """One signal row per person.

    ``weighted`` may hold :func:`weighted_entries` of the entries, made before;
    three branches read it, so at scale it is worth writing once.

    people(id, headline, about, is_open, location, skills); entries(id, ix, role,
    company_name, job_type, description, skills_used, start_date, end_date,
    is_current, duration_months).  All branches shuffle by id only.
    """
    rules = rules or Rules()
    if weighted is None:
        weighted = weighted_entries(entries, as_of, rules, fallbacks)
    feats = entity_features(weighted, as_of, rules)
    # Read by three branches; a list of skills may be gathered from far more rows than there are people.
    people = materialised(people.select("id", "headline", "about", "is_open", "location", "skills"), "people")
    declared = sk.declared_skills(people, aliases=rules.aliases)
    found = sk.evidence(weighted, declared, education, aliases=rules.aliases,
                        half_life=rules.half_life)
    profile = sk.skill_profile(declared, found)
    # A row per person each, wider in memory than their files tell: neither is broadcast.
    base = (
        person_texts(people.drop("skills"), rules)
        .join(feats.hint("merge"), "id", "left").join(profile.hint("merge"), "id", "left")
    )
    return signal_columns(base, rules)


def person_texts(people: DataFrame, rules: Rules) -> DataFrame:
    """Adds what the texts of a person alone tell; texts that repeat are read once each."""
    def headlines(df: DataFrame) -> DataFrame:
        df = df.withColumn("headline_text", tx.norm_text(F.col("headline")))
        df = df.withColumns({
            "core": tx.norm_title(F.col("headline_text"))["core"],
            "_claimed": claimed_level(F.col("headline_text")),
            "_transition": F.col("headline_text").rlike("|".join(fv.TRANSITION_PHRASES))})
        return classify(df, "core", None, "headline_cls", rules.lexicon)

    def intents(df: DataFrame) -> DataFrame:
        text = F.concat_ws(" ", tx.norm_text(F.col("headline")), tx.norm_text(F.col("about")))
        return df.withColumn("_text", text).withColumns({
            "_seeking": F.col("_text").rlike(_bounded(fv.SEEKING_PHRASES)),
            "_break": F.col("_text").rlike(_bounded(fv.BREAK_PHRASES))}).drop("_text")

    out = per_value(per_value(people, ["headline"], headlines), ["headline", "about"], intents)
    return per_value(out, ["location"], lambda df: df.withColumn("location_text", tx.norm_text(F.col("location"))))


def signal_columns(base: DataFrame, rules: Rules) -> DataFrame:
    """The record's derived columns from :func:`person_texts` and joined features; a narrow projection."""
    none = F.array().cast("array<string>")
    no, zero = F.lit(False), F.lit(0)
    df = base.withColumns({
        "role_family": F.coalesce("role_family", F.lit(fv.DEFAULT_FAMILY)),
        "role_family_alt": F.coalesce("role_family_alt", none),
        "priors": F.coalesce("priors", none),
        "history": F.coalesce("history", F.array().cast(
            "array<struct<family string, months bigint>>")),
        "n_entries": F.coalesce("n_entries", zero), "n_months": F.coalesce("n_months", zero),
        "current_months": F.coalesce("current_months", zero),
        "jobs_last_36m": F.coalesce("jobs_last_36m", zero),
        "_avg": F.coalesce("_avg_closed", "_avg_all", F.lit(0.0)),
        "_role_text": tx.norm_text(F.concat_ws(
            " ", *[tx.blank_if_null(F.col(f"_current.{c}"))
                   for c in ("role", "company_name", "job_type")])),
    })
    df = df.withColumns({
        "years_total": round_exact(F.coalesce("months_covered", zero) / F.lit(12.0), 2),
        "years_relevant": years_towards(F.col("history"), F.col("role_family"), F.col("priors"),
                                        rules.adjacency),
        "avg_tenure_months": round_exact(F.col("_avg"), 1),
        "tenure_flag": F.when(F.col("n_entries") == 0, "moderate").otherwise(
            sp.tenure_band(F.col("_avg"), F.col("jobs_last_36m"))),
        "implied": sk.implied_classes(F.col("claimed")),
        "off_domain": sk.off_domain_count(F.col("declared")),
    })
    stated = F.when(F.coalesce("_any_open", no), F.col("_open_level")).otherwise(
        F.col("_latest.level"))
    terms = intent_terms(F.col("is_open"), F.col("_seeking"), F.col("_break"), F.col("_role_text"), F.col("current_months"),
                         F.col("avg_tenure_months"), F.col("tenure_flag"))
    df = df.withColumns({
        "headline_family": F.col("headline_cls.family"),
        "seniority": F.coalesce(stated, level_from_years(
            F.col("years_relevant"), F.coalesce("intern_only", no))),
        "_terms": F.struct(*[t.alias(n) for n, t in terms.items()]),
        "unreachable": F.exists("implied", lambda f: ~F.exists(
            F.when(F.size("priors") > 0, F.col("priors")).otherwise(F.array("role_family")),
            lambda p: rules.adjacency.score(p, f, F.col("priors")) > 0)),
    })
    terms = {n: F.col(f"_terms.{n}") for n in terms}
    df = df.withColumns({
        "_inflated": F.coalesce(level_order(F.col("_claimed")) > level_order(F.col("seniority")),
                                no),
        "_p": intent_probability(terms),
        "switch_terms": F.map_filter(
            F.create_map(*[x for n, t in terms.items()
                           for x in (F.lit(n), F.when(t, fv.INTENT_WEIGHTS[n]))]),
            lambda _, v: v.isNotNull()),
    })
    mismatch = F.coalesce(F.col("headline_family") != F.col("role_family"), no)
    flags = {
        "headline_family_mismatch": mismatch,
        "high_skill_noise": F.col("noise_ratio") > 0.5,
        "headline_seniority_inflated": F.col("_inflated"),
        "no_experience_descriptions": F.coalesce("no_experience_descriptions", no),
        "duration_mismatch": F.coalesce("duration_mismatch", no),
        "date_parse_failure": F.coalesce("date_parse_failure", no),
        "fallback_classifier_used": F.coalesce("fallback_classifier_used", no),
        "thin_history": (F.col("n_entries") < 2) & (F.col("n_months") < 12),
        "unclassified_entries": F.coalesce("unclassified_entries", no),
    }
    df = df.withColumns({
        "switch_intent": round_exact(F.col("_p"), 3),
        "intent_band": intent_band(F.col("_p")),
        "confidence": confidence(flags, F.col("noise_ratio")),
        "extraction_flags": flag_list(flags),
    })
    codes = [
        F.when(F.col("_transition"), "headline_declares_transition"),
        F.when(mismatch, F.concat(F.lit("headline_family_mismatch:"), "headline_family",
                                  F.lit("!="), "role_family")),
        F.when(F.col("_inflated"), "headline_seniority_inflated"),
        F.when(F.size("claimed") > 0, "skills_not_evidenced_in_experience"),
        F.when(F.col("unreachable"), "zero_role_experience_despite_skill_claim"),
        F.when(F.col("off_domain") > 0,
               F.concat(F.lit("off_domain_skills:"), F.col("off_domain").cast("string"))),
        F.when(F.col("is_open").isNotNull(),
               F.concat(F.lit("open_to_work:"), F.col("is_open").cast("string"))),
        F.concat(F.lit("switch_intent:"), "intent_band"),
        F.concat(F.lit("tenure_flag:"), "tenure_flag"),
        F.when(terms["career_break"], "career_break"),
        F.when(flags["fallback_classifier_used"],
               F.concat(F.lit("fallback_classifier_used:"), "_fallback")),
        F.when(flags["no_experience_descriptions"], "no_experience_descriptions"),
        F.when(flags["date_parse_failure"], "date_parse_failure"),
        F.when(flags["duration_mismatch"], "duration_mismatch"),
        F.when(F.col("confidence") < fv.LOW_CONFIDENCE, "low_confidence_extraction"),
    ]
    return df.select(
        "id", "role_family", "role_family_alt", "role_family_scores", "seniority", "years_total",
        "years_relevant", "core_skills", F.col("claimed").alias("claimed_skills_unverified"),
        F.col("noise_ratio").alias("skill_noise_ratio"), "avg_tenure_months", "jobs_last_36m",
        "tenure_flag", "switch_intent", "intent_band", "switch_terms", "confidence",
        F.array_distinct(F.array_compact(F.array(*codes))).alias("reason_codes"),
        "extraction_flags", F.lit(rules.version).alias("signals_version"),
        "priors", "history", "location_text", "headline_family", "implied", "unreachable",
        "off_domain", "current_months", "n_entries",
    )


def vocabulary_violations(df: DataFrame, codes: str) -> DataFrame:
    """Distinct codes that match none of the closed templates."""
    known = F.lit(False)
    for _, pattern in fv.REASON_TEMPLATES:
        known = known | F.col("code").rlike(pattern)
    # The outer form keeps Spark from repeating the whole code expression in a filter.
    return df.select(F.explode_outer(codes).alias("code")).groupBy("code").agg(
        F.count(F.lit(1)).alias("uses")).where(F.col("code").isNotNull() & ~known)
