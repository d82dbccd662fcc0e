"""Title classification that abstains rather than guesses.

Every stage is a Column expression over constant dictionaries, so classifying a
table is a narrow projection: no join, no shuffle, nothing to skew.  Phrases are
found by one automaton for all terms, so large dictionaries cost no more.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom import vocabulary as vocab
from matchloom.functions import text as tx
from matchloom.functions import vectors as vec
from matchloom.functions.numeric import round_exact
from matchloom.functions.phrases import hits
from matchloom.operators.skew import beside_blocks, in_blocks
from matchloom.operators.values import per_value

RESULT = "struct<family string, confidence double, source string, evidence string>"


def constant_rows(rows: list[dict], ddl: str) -> Column:
    """A constant array of structs, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")


@dataclass
class Lexicon:
    patterns: list[tuple[str, str]] = field(default_factory=vocab.pattern_rows)
    ambiguous: list[str] = field(default_factory=lambda: list(vocab.AMBIGUOUS_TITLES))
    context: list[tuple[str, str, float]] = field(default_factory=vocab.context_rows)
    min_score: float = fv.CONTEXT_MIN_SCORE
    min_margin: float = fv.CONTEXT_MIN_MARGIN

    def phrases(self) -> list[str]:
        """All terms looked for in titles: patterns in order, then ambiguous titles of several words."""
        return [p for p, _ in self.patterns] + self.ambiguous_phrases()

    def ambiguous_phrases(self) -> list[str]:
        # Of equal terms the first is found, so an ambiguous title that is a pattern goes by that.
        return [a for a in self.ambiguous if " " in a]

    def pattern_array(self) -> Column:
        return constant_rows([{"pattern": p, "family": f} for p, f in self.patterns], "pattern string, family string")

    def places(self, multiword: bool) -> list[int]:
        return [i for i, (p, _) in enumerate(self.patterns) if (" " in p) == multiword]

    def term_array(self) -> Column:
        rows = [{"family": f, "term": t, "weight": w} for f, t, w in self.context]
        return constant_rows(rows, "family string, term string, weight double")

    def families(self) -> list[str]:
        return list(dict.fromkeys(f for f, _, _ in self.context))


def result(family: Column, confidence, source, evidence: Column) -> Column:
    """A classification, or null (an abstention) where ``family`` is null."""
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    src = source if isinstance(source, Column) else F.lit(source)
    return F.when(family.isNotNull(), F.struct(
        family.alias("family"), conf.cast("double").alias("confidence"), src.alias("source"),
        evidence.alias("evidence"))).otherwise(F.lit(None).cast(RESULT))


def exact_match(core: Column, lexicon: Lexicon) -> Column:
    hit = F.try_element_at(tx.literal_map(dict(lexicon.patterns)), core)
    return result(hit, fv.CONF_EXACT, "lexicon", F.concat(F.lit("exact:"), core))


def is_ambiguous(core: Column, lexicon: Lexicon) -> Column:
    return core.isin(lexicon.ambiguous)


def phrase_hits(core: Column, lexicon: Lexicon) -> Column:
    """Places in ``lexicon.phrases()`` of what a title holds; as a column, one search serves all stages."""
    return hits(core, lexicon.phrases())


def mentions_ambiguous(found: Column, lexicon: Lexicon) -> Column:
    terms = lexicon.phrases()
    places = sorted({terms.index(a) for a in lexicon.ambiguous_phrases()})
    return F.arrays_overlap(found, F.lit(places).cast("array<int>"))


def _first_hit(found: Column, lexicon: Lexicon, multiword: bool, confidence: float, tag: str) -> Column:
    places = F.lit(lexicon.places(multiword)).cast("array<int>")
    first = F.array_min(F.array_intersect(found, places))
    hit = F.get(lexicon.pattern_array(), first)
    return result(hit["family"], confidence, "lexicon", F.concat(F.lit(tag), hit["pattern"]))


def phrase_match(core: Column, lexicon: Lexicon, found: Column | None = None) -> Column:
    """Longest multiword pattern inside the title; never for an ambiguous title."""
    hit = _first_hit(phrase_hits(core, lexicon) if found is None else found, lexicon, True, fv.CONF_PHRASE, "phrase:")
    return F.when(~is_ambiguous(core, lexicon), hit)


def token_match(core: Column, lexicon: Lexicon, found: Column | None = None) -> Column:
    return _first_hit(phrase_hits(core, lexicon) if found is None else found, lexicon, False, fv.CONF_TOKEN, "token:")


def term_hits(context: Column, lexicon: Lexicon) -> Column:
    """Places of what a text holds among the distinct context terms."""
    return hits(context, list(dict.fromkeys(t for _, t, _ in lexicon.context)))


def context_hits(found: Column, lexicon: Lexicon) -> Column:
    """The context terms at the places of :func:`term_hits`, in the order of the lexicon."""
    rows: dict[str, list[int]] = {}
    for i, (_, term, _) in enumerate(lexicon.context):
        rows.setdefault(term, []).append(i)
    own = F.flatten(F.transform(found, lambda i: F.get(F.lit(list(rows.values())).cast("array<array<int>>"), i)))
    # sort_array compares natively; array_sort evaluates a function for each comparison.
    return F.transform(F.sort_array(own), lambda i: F.get(lexicon.term_array(), i))


def context_ranking(hits: Column, families: list[str]) -> Column:
    """``struct(score, family)`` per family, best first."""
    def total(f: Column) -> Column:
        mine = F.filter(hits, lambda h: h["family"] == f)
        score = F.aggregate(mine, F.lit(0.0), lambda acc, h: acc + h["weight"])
        return F.struct(score.alias("score"), f.alias("family"))
    return F.sort_array(F.transform(tx.literal_list(families), total), asc=False)


def context_vote(hits: Column, ranking: Column, lexicon: Lexicon) -> Column:
    """The family with the clear lead in context, else null."""
    best, second = ranking[0], ranking[1]
    clear = (best["score"] >= lexicon.min_score) & (
        best["score"] - second["score"] >= lexicon.min_margin)
    family = F.when(clear, best["family"])
    strength = F.when(best["score"] >= fv.CONTEXT_STRONG_SCORE, fv.CONF_CONTEXT_STRONG).otherwise(
        fv.CONF_CONTEXT_WEAK)
    terms = F.sort_array(F.transform(
        F.filter(hits, lambda h: h["family"] == best["family"]), lambda h: h["term"]))
    return result(family, strength, "lexicon",
                  F.concat(F.lit("context:"), F.array_join(F.slice(terms, 1, 3), ",")))


def classify(
    df: DataFrame, core: str, context: str | None, out: str = "cls",
    lexicon: Lexicon | None = None, fallbacks: list[Column] | None = None,
) -> DataFrame:
    """First stage that does not abstain: exact, phrase, context vote, token, fallbacks.

    ``core`` is a normalised title core and ``context`` normalised text.  A title
    that is ambiguous, or holds an ambiguous phrase, is decided by its context or
    not at all (before the fallbacks).
    """
    lexicon = lexicon or Lexicon()
    return decided(title_stage(df, core, lexicon), df.columns, core, context, out, lexicon, fallbacks)


def title_stage(df: DataFrame, core: str, lexicon: Lexicon) -> DataFrame:
    """Adds what a title alone decides: ``_x`` (exact or phrase), ``_vague`` and ``_by_token``."""
    c, found = F.col(core), F.col("_title_places")
    step = df.withColumn("_title_places", phrase_hits(c, lexicon)).withColumns({
        "_x": F.coalesce(exact_match(c, lexicon), phrase_match(c, lexicon, found)),
        "_vague": is_ambiguous(c, lexicon) | mentions_ambiguous(found, lexicon),
        "_by_token": token_match(c, lexicon, found)})
    return step.drop("_title_places")


def asks_context(core: str) -> Column:
    """Whether a title, after :func:`title_stage`, is to be decided by its context."""
    return F.col("_x").isNull() & (F.col(core) != "") & F.col("_vague")


def decided(step: DataFrame, columns: list[str], core: str, context: str | None, out: str, lexicon: Lexicon,
            fallbacks: list[Column] | None = None) -> DataFrame:
    """``columns`` of a table after :func:`title_stage`, and the class; context counts where it is asked for."""
    asks = asks_context(core)
    voted = F.lit(None).cast(RESULT)
    if context:
        # Only texts that are asked for are searched.
        step = step.withColumn("_context_asked", F.when(asks, F.col(context)))
        step = step.withColumn("_term_places", term_hits(F.col("_context_asked"), lexicon))
        given = F.col("_context_asked").isNotNull()
        step = step.withColumn("_hits", F.when(given, context_hits(F.col("_term_places"), lexicon)))
        step = step.withColumn("_rank", F.when(given, context_ranking(F.col("_hits"), lexicon.families())))
        voted = context_vote(F.col("_hits"), F.col("_rank"), lexicon)
    tokens = F.when(F.col("_x").isNull() & (F.col(core) != "") & ~F.col("_vague"), F.col("_by_token"))
    chain = F.coalesce(F.col("_x"), F.when(asks, voted), tokens, *(fallbacks or []))
    return step.select(*columns, chain.alias(out))


def with_title(df: DataFrame, title: str, core: str = "core") -> DataFrame:
    """Adds the normalised core of a raw title; titles that repeat are read once each."""
    def read(rows: DataFrame) -> DataFrame:
        normed = rows.withColumn("_nt", tx.norm_text(F.col(title)))
        return normed.withColumn(core, tx.norm_title(F.col("_nt"))["core"]).drop("_nt")

    return per_value(df, [title], read)


# ------------------------------------------------------------------ vectors
def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Unit mean vector per class."""
    cells = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return packed.select("label", vec.unit(F.transform("v", lambda p: p["m"])).alias("centroid"))


def nearest_centroid(df: DataFrame, vector: str, cents: DataFrame, by: str,
                     threshold: float = fv.CENTROID_MIN_COSINE) -> DataFrame:
    """Class of highest cosine, lowest label on ties; null below the threshold.

    ``by`` identifies a row.  Classes come in blocks; the best of each block is
    found inside the row, and only those are compared by a shuffle.
    """
    small, blocks = in_blocks(cents, F.struct("label", "centroid"))
    rows = df.withColumn("_u", vec.unit(F.col(vector)))
    best = F.array_min(F.transform("_items", lambda c: F.struct(
        (-vec.dot(F.col("_u"), c["centroid"])).alias("neg"), c["label"].alias("label"))))
    scored = beside_blocks(rows.select(by, *[c for c in rows.columns if c != by]), small, blocks).withColumn("_best", best)
    if blocks > 1:
        least = scored.select(by, "_best").groupBy(by).agg(F.min("_best").alias("_best"))
        scored = rows.join(least, by)
    cosine = -F.col("_best.neg")
    answered = (cosine >= threshold) & (vec.norm(F.col("_u")) > 0)
    return scored.select(
        *df.columns, round_exact(cosine, 6).alias("cosine"),
        F.when(answered, F.col("_best.label")).alias("predicted"),
        F.when(answered, round_exact(cosine * fv.FALLBACK_SCALE, 3)).alias("confidence"))


# ------------------------------------------------------------------ reports
def decided_by(df: DataFrame, cls: str, primary: str = "lexicon") -> DataFrame:
    """Run totals: titles seen, abstained, decided by a fallback, and the rates."""
    source = F.col(f"{cls}.source")
    totals = df.agg(
        F.count(F.lit(1)).alias("titles"),
        F.count(F.when(F.col(cls).isNull(), 1)).alias("abstained"),
        F.count(F.when(source != primary, 1)).alias("fallback"))
    return totals.select(
        "titles", "abstained", "fallback",
        round_exact(F.col("abstained") / F.col("titles"), 4).alias("abstention_rate"),
        round_exact(F.col("fallback") / F.col("titles"), 4).alias("fallback_rate"))


def accuracy_report(df: DataFrame, truth: Column, predicted: Column, novel: Column,
                    gap: Column, by: list[str] | None = None) -> DataFrame:
    """Forced accuracy, coverage, accuracy when answering; the same on novel and gap rows."""
    answered = predicted.isNotNull()
    right = F.coalesce(predicted == truth, F.lit(False))

    def n(*conds: Column) -> Column:
        cond = conds[0]
        for extra in conds[1:]:
            cond = cond & extra
        return F.count(F.when(cond, 1))

    rolled = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), n(right).alias("_right"), n(answered).alias("answered"),
        n(novel).alias("novel_n"), n(novel, answered).alias("novel_answered"),
        n(novel, right).alias("novel_correct"), n(gap).alias("gap_n"),
        n(gap, answered).alias("gap_answered"), n(gap, right).alias("gap_correct"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, round_exact(F.col(a) / F.col(b), 4))

    return rolled.select(
        *(by or []), "n", share("_right", "n").alias("accuracy_forced"),
        share("answered", "n").alias("coverage"),
        share("_right", "answered").alias("accuracy_when_answering"),
        "novel_n", "novel_answered", "novel_correct",
        share("novel_correct", "novel_answered").alias("novel_accuracy"),
        "gap_n", "gap_answered", "gap_correct")


def arm_results(df: DataFrame, sources: dict[str, str], arms: dict[str, list[str]]) -> DataFrame:
    """One row per (input row, arm): the first result among the arm's enabled sources."""
    parts = [F.struct(
        F.lit(arm).alias("arm"),
        F.coalesce(*[F.col(sources[s]) for s in enabled]).alias("cls"))
        for arm, enabled in arms.items()]
    kept = [c for c in df.columns if c not in sources.values()]
    return df.select(*kept, F.explode(F.array(*parts)).alias("_a")).select(*kept, "_a.*")


def corpus_gate(corpus: DataFrame, title: str, label: str, classes: DataFrame,
                previous_rows: Column) -> DataFrame:
    """Case-insensitive dedupe count, missing classes, and whether the corpus may be written."""
    kept = corpus.select(F.lower(title).alias("t"), F.col(label).alias(label)).distinct()
    size = kept.agg(F.count(F.lit(1)).alias("rows_kept"))
    missing = classes.join(kept.select(label).distinct(), label, "left_anti").agg(
        F.count(F.lit(1)).alias("missing_classes"))
    ok = (F.col("missing_classes") == 0) & (F.col("rows_kept") >= previous_rows * fv.CORPUS_MIN_SHARE)
    return size.withColumn("missing_classes", missing.scalar()).select(
        "rows_kept", "missing_classes", ok.alias("accepted"))


def holdout_rows(entries: DataFrame, labels: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries with title, company, context and label, entries that no label names).

    A label row with a null class is a deliberate gap; a missing label row is an error.
    """
    context = F.trim(F.concat_ws(" ", F.nullif("description", F.lit("")),
                                 F.nullif(F.array_join("skills_used", " "), F.lit(""))))
    rows = entries.select(*key, F.col("role").alias("title"), F.col("company_name").alias("company"),
                          context.alias("context"))
    return rows.join(labels, key, "inner"), rows.join(labels.select(*key), key, "left_anti")
