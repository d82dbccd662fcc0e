"""Queries over classification, vectors and trained fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom import vocabulary as vocab
from matchloom.functions import text as tx
from matchloom.functions.numeric import round_exact
from matchloom.operators import classify as cl
from matchloom.operators import monitor as mon
from matchloom.operators import signals as sg
from matchloom.operators import training as tr
from matchloom.operators.skew import selected_values
from matchloom.plans import demo
from matchloom.plans.q_text import sql_title
from matchloom.plans.registry import cte, query, shared, table
from matchloom.plans.sqltext import any_phrase, boundary, joined, norm, phrase, rx, values

cte("dim_pattern", "SELECT * FROM (VALUES " + values(
    [(p, f, i, 1 if " " in p else 0, boundary(p)) for i, (p, f) in enumerate(vocab.pattern_rows())])
    + ") t(pattern, family, ord, multi, rx)")
cte("dim_ambiguous", f"SELECT * FROM (VALUES {values([(a, boundary(a)) for a in vocab.AMBIGUOUS_TITLES])}) t(title, rx)")
cte("dim_context", f"SELECT * FROM (VALUES {values([(*r, boundary(r[1])) for r in vocab.context_rows()])}) t(family, term, weight, rx)")

cte("entry_text", f"""
  SELECT e.id, e.ix, c.core, {norm('e.role')} AS role_text,
    {norm("coalesce(e.description, '') || ' ' || array_to_string(e.skills_used, ' ')")} AS context,
    s.start_on IS NOT NULL AS usable
  FROM entries e JOIN spans s USING (ix) JOIN (
    {sql_title('(SELECT DISTINCT role FROM raw_entries)', 'role', 'role')}) c ON c.role = e.role""",
    ("entries", "spans", "raw_entries"))

cte("core_base", f"""
  SELECT c.core, x.family AS exact_family,
    (SELECT arg_min(family, ord) FROM dim_pattern p WHERE multi = 1 AND {phrase('c.core', 'p.pattern')}
       AND c.core NOT IN (SELECT title FROM dim_ambiguous)) AS phrase_family,
    c.core IN (SELECT title FROM dim_ambiguous) OR EXISTS (SELECT 1 FROM dim_ambiguous a
       WHERE a.title LIKE '% %' AND {phrase('c.core', 'a.title')}) AS vague,
    (SELECT arg_min(family, ord) FROM dim_pattern p WHERE multi = 0 AND {phrase('c.core', 'p.pattern')})
       AS token_family
  FROM (SELECT DISTINCT core FROM entry_text) c LEFT JOIN dim_pattern x ON x.pattern = c.core""",
    ("dim_pattern", "dim_ambiguous", "entry_text"))

cte("context_votes", f"""
  SELECT id, ix, arg_max(family, score) AS family, max(score) AS best,
    coalesce(list_sort(list(score), 'DESC')[2], 0) AS second FROM (
    SELECT t.id, t.ix, d.family, CAST(sum(d.weight) AS DOUBLE) AS score
    FROM entry_text t JOIN core_base b USING (core) JOIN dim_context d ON {phrase('t.context', 'd.term')}
    WHERE b.exact_family IS NULL AND b.phrase_family IS NULL AND b.vague GROUP BY ALL)
  GROUP BY id, ix""", ("entry_text", "core_base", "dim_context"))

cte("classified", """
  SELECT t.id, t.ix, t.core, t.usable,
    CASE WHEN NOT t.usable OR t.core = '' THEN NULL WHEN exact_family IS NOT NULL THEN exact_family
      WHEN phrase_family IS NOT NULL THEN phrase_family
      WHEN vague THEN CASE WHEN best >= 1.0 AND best - second >= 0.5 THEN v.family END
      ELSE token_family END AS family,
    CAST(CASE WHEN exact_family IS NOT NULL THEN 1.0 WHEN phrase_family IS NOT NULL THEN 0.9
      WHEN vague THEN CASE WHEN best >= 2.0 THEN 0.8 ELSE 0.6 END ELSE 0.75 END AS DOUBLE) AS confidence,
    CASE WHEN exact_family IS NOT NULL THEN 'exact' WHEN phrase_family IS NOT NULL THEN 'phrase'
      WHEN vague THEN 'context' ELSE 'token' END AS stage
  FROM entry_text t JOIN core_base b USING (core)
  LEFT JOIN context_votes v ON v.id = t.id AND v.ix = t.ix""",
    ("entry_text", "core_base", "context_votes"))


def titled(spark, sf):
    rows = cl.with_title(demo.orders_as_entries(spark, sf), "role")
    return rows.select("ix", "core"), cl.Lexicon()


@query("classify_exact", """
  SELECT t.ix, t.core, b.exact_family AS family FROM entry_text t JOIN core_base b USING (core)""",
       ("entry_text", "core_base"))
def classify_exact(spark, sf):
    rows, lexicon = titled(spark, sf)
    return rows.select("ix", "core", cl.exact_match(F.col("core"), lexicon)["family"].alias("family"))


@query("classify_phrase", """
  SELECT t.ix, t.core, b.phrase_family AS family FROM entry_text t JOIN core_base b USING (core)""",
       ("entry_text", "core_base"))
def classify_phrase(spark, sf):
    rows, lexicon = titled(spark, sf)
    return rows.select("ix", "core", cl.phrase_match(F.col("core"), lexicon)["family"].alias("family"))


@query("classify_token", """
  SELECT t.ix, t.core, b.token_family AS family FROM entry_text t JOIN core_base b USING (core)""",
       ("entry_text", "core_base"))
def classify_token(spark, sf):
    rows, lexicon = titled(spark, sf)
    return rows.select("ix", "core", cl.token_match(F.col("core"), lexicon)["family"].alias("family"))


# Function words of four languages, as context terms for whole documents.
WORD_VOTES = [("en", "the", 1.0), ("en", "with", 1.5), ("en", "that", 1.5), ("fr", "les", 1.0),
              ("fr", "une", 1.5), ("fr", "que", 0.5), ("de", "und", 1.5), ("de", "der", 1.0),
              ("es", "los", 1.5), ("es", "que", 0.5), ("es", "con", 1.0)]


@query("context_vote", f"""
  WITH dim AS (SELECT * FROM (VALUES {values(WORD_VOTES)}) t(family, term, weight)),
  docs AS (SELECT doc_id, {norm('text')} AS t FROM documents),
  scores AS (SELECT doc_id, family, CAST(sum(weight) AS DOUBLE) AS score FROM docs JOIN dim
    ON CASE term {" ".join(f"WHEN '{t}' THEN {any_phrase('t', [t])}" for t in dict.fromkeys(w[1] for w in WORD_VOTES))} END
    GROUP BY doc_id, family),
  best AS (SELECT doc_id, arg_max(family, score) AS family, max(score) AS best,
    coalesce(list_sort(list(score), 'DESC')[2], 0) AS second FROM scores GROUP BY doc_id)
  SELECT doc_id, CASE WHEN best >= 1.0 AND best - second >= 0.5 THEN family END AS family,
    CASE WHEN best >= 1.0 AND best - second >= 0.5 THEN CAST(CASE WHEN best >= 2 THEN 0.8 ELSE 0.6 END AS DOUBLE) END AS confidence
  FROM docs LEFT JOIN best USING (doc_id)""")
def context_vote(spark, sf):
    lexicon = cl.Lexicon(context=WORD_VOTES)
    docs = table(spark, sf, "documents").select("doc_id", tx.norm_text(F.col("text")).alias("t"))
    found = docs.withColumn("f", cl.term_hits(F.col("t"), lexicon))
    hits = found.withColumn("h", cl.context_hits(F.col("f"), lexicon))
    ranked = hits.withColumn("r", cl.context_ranking(F.col("h"), lexicon.families()))
    vote = ranked.withColumn("v", cl.context_vote(F.col("h"), F.col("r"), lexicon))
    return vote.select("doc_id", "v.family", "v.confidence")


@shared
def classified(spark, sf):
    return sg.classified_entries(demo.entries(spark, sf), demo.as_of(), sg.Rules())


@query("classify_chain", """
  SELECT ix, core, family, CASE WHEN family IS NOT NULL THEN confidence END AS confidence,
    CASE WHEN family IS NOT NULL THEN stage END AS stage FROM classified""", ("classified",))
def classify_chain(spark, sf):
    return classified(spark, sf).select(
        "ix", "core", "cls.family", "cls.confidence",
        F.regexp_extract("cls.evidence", "^([a-z]+):", 1).alias("stage"))


NOUN_CLASSES = {"anvil": "tools", "gear": "tools", "bolt": "fasteners", "rod": "fasteners",
                "ring": "flat", "plate": "flat", "gizmo": "gadgets", "widget": "gadgets"}


@query("fold_sizes", f"""
  SELECT label, fold, count(*) AS n FROM (
    SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('{fv.BOOTSTRAP_SEED}|' || coalesce(label || '|', '') || core), core) - 1) % 5 AS INTEGER) AS fold
    FROM (SELECT DISTINCT core, CASE noun {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOUN_CLASSES.items())} END AS label
      FROM (SELECT p_name, list_extract(string_split(p_name, ' '), -1) AS noun FROM part)
      JOIN ({sql_title("(SELECT DISTINCT p_name FROM part)", 'p_name', 'p_name')}) t USING (p_name))) GROUP BY label, fold""")
def fold_sizes(spark, sf):
    corpus = tr.corpus_rows(part_titles(spark, sf), "core", "label")
    return tr.folds(corpus).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def part_titles(spark, sf):
    part = cl.with_title(table(spark, sf, "part"), "p_name")
    noun = F.element_at(F.split("p_name", " "), -1)
    return part.withColumn("label", F.try_element_at(tx.literal_map(NOUN_CLASSES), noun))


def _grams_sql(n: int) -> str:
    return (f"flatten(list_transform(ws, lambda w: list_transform(range(1, greatest(1, length(w) + 3 - {n}) + 1), "
            f"lambda i: substr(' ' || w || ' ', i, {n}))))")


cte("part_titles_sql", sql_title("(SELECT DISTINCT p_name FROM part)", "p_name", "p_name"))

cte("title_grams", f"""
  SELECT core, ws, list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS words,
    list_concat({_grams_sql(3)}, list_concat({_grams_sql(4)}, {_grams_sql(5)})) AS chars
  FROM (SELECT core, ws, list_filter(ws, lambda w: length(w) > 1) AS k FROM (
    SELECT DISTINCT core, string_split(core, ' ') AS ws FROM part_titles_sql))""", ("part_titles_sql",))

cte("title_counts", f"""
  SELECT core, block, (('0x' || substr(md5(g), 1, 6))::BIGINT & {(1 << tr.BITS) - 1}) AS bucket, count(*) AS n FROM (
    SELECT core, 0 AS block, unnest(chars) AS g FROM title_grams UNION ALL SELECT core, 1, unnest(words) FROM title_grams)
  GROUP BY ALL""", ("title_grams",))


@query("title_features", f"""
  SELECT core, bucket + block * {1 << tr.BITS} AS feature,
    {rx("(v / sqrt(sum(v * v) OVER (PARTITION BY core, block)))", 9)} AS value FROM (
    SELECT *, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM title_grams))::DOUBLE
      / (1 + count(*) OVER (PARTITION BY block, bucket))) + 1) AS v FROM title_counts)""", ("title_grams", "title_counts"))
def title_features(spark, sf):
    """The weighted features of every distinct title, as the trained classifier reads them."""
    titles = part_titles(spark, sf).select("core").distinct()
    rows = tr.feature_rows(titles, "core", tr.weigh(titles, "core"))
    return rows.select("core", F.col("feature").cast("bigint").alias("feature"), round_exact(F.col("value"), 9).alias("value"))


@query("train_classifier")
def train_classifier(spark, sf):
    corpus = tr.corpus_rows(part_titles(spark, sf), "core", "label")
    model = tr.train(corpus)
    return tr.predict(corpus, "core", model).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("forced") == F.col("label"), 1)).alias("correct"))


@query("cv_accuracy")
def cv_accuracy(spark, sf):
    corpus = tr.corpus_rows(part_titles(spark, sf), "core", "label")
    return tr.cross_validate(corpus)


@query("predict_abstain")
def predict_abstain(spark, sf):
    rows = part_titles(spark, sf)
    model = tr.train(tr.corpus_rows(rows, "core", "label"))
    typed = rows.withColumn("core", F.when(F.col("p_partkey") % 4 == 0, F.lower("p_type"))
                            .otherwise(F.col("core")))
    return tr.predict(typed.select("p_partkey", "core", "label"), "core", model).select(
        "p_partkey", "core", "label", "fallback.family", "fallback.confidence")


cte("centroids", """
  SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS centroid
  FROM (SELECT label, list(m ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos,
      CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos) GROUP BY label)""")

cte("nearest", f"""
  SELECT vec_id, label, {rx('c', 6)} AS cosine, CASE WHEN c >= 0.35 THEN best END AS predicted,
    CASE WHEN c >= 0.35 THEN {rx('(c * 0.9::DOUBLE)', 3)} END AS confidence
  FROM (SELECT vec_id, label, arg_min(cl, struct_pack(a := -cos, b := cl)) AS best, max(cos) AS c FROM (
    SELECT e.vec_id, e.label, c.label AS cl, list_sum(list_transform(range(1, len(u) + 1),
      lambda i: u[i] * centroid[i])) AS cos
    FROM (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
      FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)) e,
      centroids c) GROUP BY vec_id, label)""", ("centroids",))


@query("centroids", f"""
  SELECT label, i - 1 AS pos, {rx('x', 6)} AS value FROM (SELECT label,
    unnest(range(1, len(centroid) + 1)) AS i, unnest(centroid) AS x FROM centroids)""", ("centroids",))
def centroids(spark, sf):
    made = cl.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return made.select("label", F.posexplode("centroid").alias("pos", "x")).select(
        "label", F.col("pos").cast("bigint").alias("pos"), round_exact(F.col("x"), 6).alias("value"))


@shared
def nearest(spark, sf):
    rows = table(spark, sf, "embeddings")
    return cl.nearest_centroid(rows, "embedding", cl.centroids(rows, "label", "embedding"), "vec_id")


@query("nearest_centroid", "SELECT vec_id, cosine, predicted, confidence FROM nearest", ("nearest",))
def nearest_centroid(spark, sf):
    return nearest(spark, sf).select("vec_id", "cosine", "predicted", "confidence")


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {rx(f'({a}::DOUBLE / {b})', 4)} END"


cte("report", """
  SELECT count(*) AS n, count(*) FILTER (ok) AS hit, count(predicted) AS answered,
    count(*) FILTER (vec_id % 5 = 0) AS novel_n, count(predicted) FILTER (vec_id % 5 = 0) AS novel_answered,
    count(*) FILTER (vec_id % 5 = 0 AND ok) AS novel_correct, count(*) FILTER (label >= 7) AS gap_n,
    count(predicted) FILTER (label >= 7) AS gap_answered, count(*) FILTER (label >= 7 AND ok) AS gap_correct
  FROM (SELECT *, coalesce(predicted = label, FALSE) AS ok FROM nearest)""", ("nearest",))


@query("classifier_report", f"""
  SELECT n, {_share('hit', 'n')} AS accuracy_forced, {_share('answered', 'n')} AS coverage,
    {_share('hit', 'answered')} AS accuracy_when_answering, novel_n, novel_answered, novel_correct,
    {_share('novel_correct', 'novel_answered')} AS novel_accuracy, gap_n, gap_answered, gap_correct
  FROM report""", ("report",))
def classifier_report(spark, sf):
    return cl.accuracy_report(nearest(spark, sf), F.col("label"), F.col("predicted"),
                              F.col("vec_id") % 5 == 0, F.col("label") >= 7)


cte("arm_rows", """
  SELECT arm, doc_id, n_chars, CASE WHEN n_chars > 200 THEN 1 ELSE 0 END AS truth, predicted FROM (
    SELECT 'quality' AS arm, doc_id, quality AS predicted FROM labels
    UNION ALL SELECT 'toxic', doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 1 - toxic END FROM labels)
  JOIN documents USING (doc_id)""")


@query("arm_summary", f"""
  SELECT arm, n, valid, correct, {rx('(correct::DOUBLE / n)', 4)} AS accuracy, confusions, mean_chars, max_chars, p50_chars
  FROM (SELECT arm, count(*) AS n, count(predicted) AS valid, count(*) FILTER (predicted = truth) AS correct,
    coalesce(array_to_string(list_sort(list(DISTINCT truth || ' -> ' || coalesce(CAST(predicted AS VARCHAR), 'none'))
      FILTER (coalesce(predicted <> truth, TRUE))), '; '), '') AS confusions,
    {rx('avg(n_chars)', 2)} AS mean_chars, max(n_chars) AS max_chars,
    CAST(list_sort(list(n_chars))[CAST(count(*) // 2 AS BIGINT) + 1] AS DOUBLE) AS p50_chars
    FROM arm_rows GROUP BY arm)""", ("arm_rows",))
def arm_summary(spark, sf):
    predicted = F.array(
        F.struct(F.lit("quality").alias("arm"), F.col("quality").alias("predicted")),
        F.struct(F.lit("toxic").alias("arm"),
                 F.when(F.col("doc_id") % 10 != 0, 1 - F.col("toxic")).alias("predicted")))
    both = table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = both.select("doc_id", "n_chars", F.explode(predicted).alias("a")).select(
        "doc_id", "n_chars", "a.*",
        F.when(F.col("n_chars") > 200, 1).otherwise(0).alias("truth"))
    quality = mon.arm_summary(rows, "arm", F.col("truth"), F.col("predicted"),
                              F.col("predicted").isNotNull())
    size = rows.groupBy("arm").agg(round_exact(F.avg("n_chars"), 2).alias("mean_chars"),
                                   F.max("n_chars").alias("max_chars"))
    middle = selected_values(rows, "n_chars", {"p50": F.floor(F.col("n") / 2)}, ["arm"])
    return quality.join(size, "arm").join(
        middle.select("arm", F.col("n_chars").alias("p50_chars")), "arm")


@query("holdout_rows", """
  SELECT id, ix, role AS title, company_name AS company,
    trim(array_to_string(list_filter([coalesce(description, ''), array_to_string(skills_used, ' ')], lambda p: p <> ''), ' ')) AS context,
    CASE WHEN ix % 5 <> 0 THEN job_type END AS role_family, ix % 7 <> 0 AS labelled
  FROM entries""", ("entries",))
def holdout_rows(spark, sf):
    entries = demo.entries(spark, sf)
    labels = entries.where("ix % 7 <> 0").select("id", "ix", F.when(
        F.col("ix") % 5 != 0, F.col("job_type")).alias("role_family"))
    rows, missing = cl.holdout_rows(entries, labels, ["id", "ix"])
    extra = missing.join(entries.select("id", "ix", "job_type"), ["id", "ix"]).select(
        *missing.columns, F.when(F.col("ix") % 5 != 0, F.col("job_type")).alias("role_family"))
    return rows.withColumn("labelled", F.lit(True)).unionByName(
        extra.withColumn("labelled", F.lit(False)))


@query("corpus_gate", """
  SELECT rows_kept, missing_classes, missing_classes = 0 AND rows_kept >= 60 * 0.7 AS accepted FROM (
    SELECT (SELECT count(*) FROM (SELECT DISTINCT lower(p_name), p_type FROM part)) AS rows_kept,
      (SELECT count(*) FROM (SELECT DISTINCT c_mktsegment AS p_type FROM customer
         UNION SELECT DISTINCT p_type FROM part) WHERE p_type NOT IN (SELECT p_type FROM part)) AS missing_classes)""")
def corpus_gate(spark, sf):
    part = table(spark, sf, "part")
    wanted = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("p_type")).union(
        part.select("p_type")).distinct()
    return cl.corpus_gate(part, "p_name", "p_type", wanted, F.lit(60))


@query("arm_variants", """
  SELECT ix, arm, CASE WHEN arm = 'lexicon_only' THEN family ELSE coalesce(family, other) END AS family
  FROM (SELECT c.ix, c.family, CASE WHEN c.usable THEN lower(e.job_type) END AS other FROM classified c JOIN entries e USING (ix)),
    (VALUES ('lexicon_only'), ('lexicon_kind')) a(arm)""", ("classified", "entries"))
def arm_variants(spark, sf):
    rows = classified(spark, sf)
    kind = cl.result(F.when(F.col("start_on").isNotNull(), F.lower("job_type")), 0.5, "kind",
                     F.lit("kind"))
    both = rows.select("ix", F.col("cls").alias("lexicon"), kind.alias("kind"))
    arms = {"lexicon_only": ["lexicon"], "lexicon_kind": ["lexicon", "kind"]}
    return cl.arm_results(both, {"lexicon": "lexicon", "kind": "kind"}, arms).select(
        "ix", "arm", "cls.family")
