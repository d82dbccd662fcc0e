"""Declared skills and the evidence for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom import vocabulary as vocab
from matchloom.functions import dates as dt
from matchloom.functions import text as tx
from matchloom.functions.numeric import let, round_exact
from matchloom.operators.values import beside_values, few, replaced


def canonical_list(items: Column, aliases: dict[str, str], raw_first: bool = False) -> Column:
    """Normalised, alias-resolved, first-seen-deduplicated list; blanks dropped."""
    table = tx.literal_map(aliases)
    items = F.coalesce(tx.norm_nested(items, "array<string>"), F.array().cast("array<string>"))

    def one(item: Column) -> Column:
        normed = tx.norm_plain(item)
        if raw_first:
            normed = tx.norm_skill(normed)
        return tx.norm_skill(normed, table)

    return F.array_distinct(F.filter(F.transform(items, one), lambda s: s != ""))


def with_canonical(df: DataFrame, items: str, out: str, aliases: dict[str, str], raw_first: bool = False) -> DataFrame:
    """Adds :func:`canonical_list` of ``items``; if distinct items are few, each is worked out once."""
    own = df.select(F.explode(items).alias("item")).where("item is not null")
    if few(own, ["item"]) is None:
        return df.withColumn(out, canonical_list(F.col(items), aliases, raw_first))
    names = own.distinct().select("item", F.get(canonical_list(F.array("item"), aliases, raw_first), F.lit(0)).alias("name"))
    return df.withColumn(out, F.array_distinct(replaced(F.col(items), {r["item"]: r["name"] for r in names.collect()})))


def declared_skills(people: DataFrame, by: str = "id", skills: str = "skills",
                    aliases: dict[str, str] | None = None) -> DataFrame:
    aliases = vocab.alias_map() if aliases is None else aliases
    return with_canonical(people.select(by, skills), skills, "declared", aliases).select(by, "declared")


def evidence(
    entries: DataFrame, declared: DataFrame, education: DataFrame | None = None,
    by: str = "id", ix: str = "ix", aliases: dict[str, str] | None = None,
    half_life: float = fv.HALF_LIFE_MONTHS,
) -> DataFrame:
    """(entity, skill, source, weight) for each declared skill that the history backs.

    ``entries`` carries ``attributed`` months and ``age``.  A declared list
    travels as one array on each of its entity's entries and is matched there,
    so only hits become rows.  It is met by a sort-merge join: files hold lists of
    few skills in little room, so that their size would have them broadcast, and are
    far larger in memory.  A phrase is looked for as a substring of the description's
    tokens, a single word as a token.
    """
    aliases = vocab.alias_map() if aliases is None else aliases
    owned = declared.hint("merge")
    base = with_canonical(entries.select(by, ix, "company_name", "attributed", "age", "description", "skills_used"),
                          "skills_used", "_used", aliases, raw_first=True).drop("skills_used")
    named = _names_in_text(entries, declared)
    if named is None:
        base = base.withColumn("_toks", tx.tokens(tx.norm_text(F.col("description")))).drop("description").join(owned, by)
        base = base.withColumns({"_desc": F.array_join("_toks", " "), "_by_used": F.array_intersect("declared", "_used")})
        by_text = F.filter(F.array_except("declared", "_by_used"), _in_text)
    else:
        # Entries that can back no skill stay behind.
        base = beside_values(base, ["description"], named).drop("description").where(
            (F.size("_used") > 0) | (F.size("_named") > 0)).join(owned, by)
        base = base.withColumn("_by_used", F.array_intersect("declared", "_used"))
        by_text = F.array_intersect(F.array_except("declared", "_by_used"), "_named")
    base = base.withColumn("_by_text", by_text)
    hits = F.concat(
        F.transform("_by_used", lambda s: F.struct(
            s.alias("skill"), F.lit("skills_used").alias("how"), F.lit(1.0).alias("share"))),
        F.transform("_by_text", lambda s: F.struct(
            s.alias("skill"), F.lit("description").alias("how"), F.lit(0.8).alias("share"))))
    months = F.coalesce("attributed", F.lit(0)).cast("double")
    rows = base.select(by, ix, "company_name", months.alias("_m"),
                       F.coalesce("age", F.lit(0)).alias("_age"),
                       F.explode(hits).alias("h")).select(
        by, F.lit(0).alias("_kind"), F.col(ix).alias("_ix"),
        F.col("h.skill").alias("skill"),
        F.concat("h.how", F.lit("@"), F.coalesce(F.nullif("company_name", F.lit("")), F.lit("?")))
        .alias("source"),
        (F.col("_m") * dt.decay(F.col("_age"), half_life) * F.col("h.share")).alias("w"))
    if education is not None:
        studied = education.join(owned, by).select(
            by, F.lit(1).alias("_kind"), F.col(ix).alias("_ix"),
            F.explode(F.array_intersect(
                "declared", canonical_list(F.col("skills"), aliases))).alias("skill"),
            F.concat(F.lit("education@"),
                     F.coalesce(F.nullif("school_name", F.lit("")), F.lit("?"))).alias("source"),
            F.lit(0.0).alias("w"))
        rows = rows.unionByName(studied)
    return rows.groupBy(by, "skill").agg(
        F.min_by("source", F.struct("_kind", "_ix")).alias("source"),
        round_exact(F.sum("w"), 6).alias("weight"))


def _in_text(skill: Column) -> Column:
    """Whether a description, as ``_toks`` and the joined ``_desc``, shows a skill."""
    phrase = skill.contains(" ") | skill.contains(".") | skill.contains("/")
    return F.when(phrase, F.contains(F.col("_desc"), skill)).otherwise(F.array_contains(F.col("_toks"), skill))


#: Pairs of a distinct description and a distinct declared skill that are compared at most.
HELD_PAIRS = 20_000_000


def _names_in_text(entries: DataFrame, declared: DataFrame) -> DataFrame | None:
    """``description, _named``: the declared skills that each description shows, if there are few of both."""
    texts, owned = few(entries, ["description"]), declared.select(F.explode("declared").alias("skill"))
    names = few(owned, ["skill"]) if texts is not None else None
    if texts is None or names is None or texts * names > HELD_PAIRS:
        return None
    skills = sorted(r["skill"] for r in owned.distinct().collect())
    rows = entries.select("description").distinct().withColumn("_toks", tx.tokens(tx.norm_text(F.col("description"))))
    return rows.withColumn("_desc", F.array_join("_toks", " ")).select(
        "description", F.filter(tx.literal_list(skills), _in_text).alias("_named"))


def evidence_rank(found: DataFrame, by: str = "id") -> DataFrame:
    """Evidenced skills per entity by recency weight, then name."""
    window = Window.partitionBy(by).orderBy(F.desc("weight"), "skill")
    return found.withColumn("position", F.row_number().over(window).cast("bigint"))


def skill_profile(declared: DataFrame, found: DataFrame, by: str = "id") -> DataFrame:
    """Declared, core (ranked) and claimed lists, and the share claimed without evidence."""
    ranked = found.groupBy(by).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("weight")).alias("neg"), "skill"))).alias("_core"))
    out = declared.join(ranked, by, "left").withColumn(
        "core_skills", F.coalesce(F.transform("_core", lambda s: s["skill"]),
                                  F.array().cast("array<string>")))
    out = out.withColumn("claimed", F.array_except("declared", "core_skills"))
    return out.select(
        by, "declared", "core_skills", "claimed", noise_ratio(
            F.size("claimed"), F.size("declared")).alias("noise_ratio"))


def noise_ratio(claimed: Column, declared: Column) -> Column:
    return F.when(declared == 0, 0.0).otherwise(round_exact(claimed / declared, 3))


def off_domain_count(declared: Column, off_domain: list[str] | None = None) -> Column:
    listed = vocab.OFF_DOMAIN_SKILLS if off_domain is None else off_domain
    return F.size(F.array_intersect(declared, tx.literal_list(listed)))


def implied_classes(claimed: Column, skill_families: dict[str, str] | None = None,
                    minimum: int = vocab.CLAIMED_FAMILY_MIN_SKILLS) -> Column:
    """Engineering classes that at least ``minimum`` unevidenced skills point at."""
    table = vocab.skill_family_map() if skill_families is None else skill_families
    families = [f for f in dict.fromkeys(table.values()) if f != fv.DEFAULT_FAMILY]
    pointed = F.transform(claimed, lambda s: F.try_element_at(tx.literal_map(table), s))
    # Bound, so that the skills are looked up once and not for every family.
    return let(pointed, lambda own: F.filter(
        tx.literal_list(families), lambda f: F.size(F.filter(own, lambda p: p == f)) >= minimum))
