"""Job specs read into requirements, a class, a city and a band."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom import vocabulary as vocab
from matchloom.functions import text as tx
from matchloom.functions.numeric import let
from matchloom.operators.classify import classify, constant_rows
from matchloom.operators.signals import Rules

# ---------------------------------------------------------------- fixed values
ALTERNATIVE_SPLIT = r"\s+or\s+|\s*/\s*|\s*,\s*|\s*\|\s*"
PARENTHESES = r"\(([^)]*)\)"
PLACE_WORDS = r"\b(remote|hybrid|on-site|onsite|india)\b"
# ------------------------------------------------------------ end fixed values


def alternatives(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical alternatives of one requirement string, first seen first."""
    table = tx.literal_map(vocab.alias_map() if aliases is None else aliases)
    inner = F.array_join(F.regexp_extract_all(text, F.lit(PARENTHESES), 1), " ")
    whole = F.concat(F.regexp_replace(text, PARENTHESES, " "), F.lit(" , "), inner)
    fillers = r"(?U)\b(" + "|".join(fv.REQUIREMENT_FILLERS) + r")\b"

    concepts = constant_rows(
        [{"concept": c, "synonyms": s} for c, s in fv.CONCEPT_SYNONYMS.items()],
        "concept string, synonyms array<string>")

    def cleaned(part: Column) -> Column:
        return tx.squeeze(F.regexp_replace(tx.norm_plain(part), fillers, " "))

    def with_synonyms(part: Column) -> Column:
        held = F.filter(concepts, lambda c: F.contains(part, c["concept"]))
        return F.concat(F.array(part), F.flatten(F.transform(held, lambda c: c["synonyms"])))

    parts = F.filter(F.transform(F.split(whole, ALTERNATIVE_SPLIT), cleaned), lambda p: p != "")
    names = F.transform(F.flatten(F.transform(parts, with_synonyms)),
                        lambda s: tx.norm_skill(s, table))
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def requirement(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """struct(raw, kind, alternatives, terms, label) of one requirement string."""
    marked = "|".join(re.escape(marker) for marker in fv.EVIDENCE_MARKERS)

    def words(normed: Column) -> Column:
        return F.filter(F.regexp_extract_all(normed, F.lit(r"([a-z0-9-]+)"), 1),
                        lambda w: ~w.isin(fv.EVIDENCE_STOP_WORDS) & (F.length(w) > 2))

    def read(normed: Column) -> Column:
        return F.struct(
            text.alias("raw"),
            F.when(normed.rlike(marked), "evidence").otherwise("skill").alias("kind"),
            alternatives(text, aliases).alias("alternatives"),
            F.when(normed.rlike(marked), words(normed)).otherwise(
                F.array().cast("array<string>")).alias("terms"),
            tx.label_slug(normed).alias("label"))

    return let(tx.norm_plain(text), read)


def job_city(normed: Column) -> Column:
    city = F.regexp_replace(normed, PARENTHESES, " ")
    city = F.regexp_replace(city, PLACE_WORDS, " ")
    return tx.squeeze(F.regexp_replace(city, r"[^a-z ]", " "))


def with_job_class(jobs: DataFrame, rules: Rules) -> DataFrame:
    """Adds the class from the title, then from the query; null where neither decides."""
    query = F.coalesce("raw_query", F.lit(""))
    texts = jobs.select("job_id", query.alias("_q"),
                        F.posexplode(F.array("title", query)).alias("_at", "_text"))
    texts = texts.withColumns({"_q": tx.norm_text(F.col("_q")), "_text": tx.norm_text(F.col("_text"))})
    texts = texts.withColumn("_core", tx.norm_title(F.col("_text"))["core"])
    decided = classify(texts, "_core", "_q", "_cls", rules.lexicon)
    first = decided.groupBy("job_id").agg(F.min_by(
        F.struct("_at", "_cls"), F.when(F.col("_cls").isNotNull(), F.col("_at"))).alias("_f"))
    evidence = F.concat(F.when(F.col("_f._at") == 1, "raw_query:").otherwise(""), "_f._cls.evidence")
    return jobs.join(first, "job_id").select(
        *jobs.columns, F.col("_f._cls.family").alias("job_family"),
        evidence.alias("family_evidence"))


def parse_jobs(jobs: DataFrame, rules: Rules | None = None, strict: bool = True) -> DataFrame:
    """Scoreable jobs.  With ``strict`` an unresolved class fails the job, never defaults."""
    rules = rules or Rules()
    df = with_job_class(jobs, rules)
    if strict:
        refused = F.raise_error(F.concat(F.lit("no class for job "), F.col("job_id").cast("string")))
        df = df.withColumn("job_family", F.when(
            F.col("job_family").isNull(), refused.cast("string")).otherwise(F.col("job_family")))
    place = tx.norm_text(F.col("location"))

    def parsed(name: str) -> Column:
        items = F.coalesce(tx.norm_nested(F.col(name), "array<string>"),
                           F.array().cast("array<string>"))
        return F.transform(items, lambda t: requirement(t, rules.aliases)).alias(name)

    return df.select(
        "job_id", "job_family", "family_evidence", F.col("min_years").cast("double"),
        F.col("max_years").cast("double"), parsed("must_have"), parsed("good_to_have"),
        job_city(place).alias("city"), place.contains("remote").alias("is_remote"))
