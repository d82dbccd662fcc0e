"""Queries over ranking metrics: documents ranked per language in two ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions.numeric import round_exact
from matchloom.operators import evaluate as ev
from matchloom.operators.skew import ranked
from matchloom.plans.registry import cte, query, shared, table
from matchloom.plans.sqltext import rx

DRAWS = fv.BOOTSTRAP_RESAMPLES
SEED = fv.BOOTSTRAP_SEED
# System a ranks long documents first, system b by a digit of the id.
ORDERS = {"a": ("score_a DESC, item", "n_chars"), "b": ("score_b DESC, item", "(doc_id * 7919) % 1000")}

cte("grades", "SELECT d.lang AS query, d.doc_id AS item, l.quality * 2 + (1 - l.toxic) AS rel "
    "FROM labels l JOIN documents d USING (doc_id)")
cte("ranking", f"SELECT lang AS query, doc_id AS item, {ORDERS['a'][1]} AS score_a, {ORDERS['b'][1]} AS score_b FROM documents")
for _s in ORDERS:
    cte(f"list_{_s}", f"""SELECT r.query, r.item, g.rel, row_number() OVER (PARTITION BY r.query ORDER BY {ORDERS[_s][0]}) AS position
      FROM ranking r JOIN grades g USING (query, item)""", ("ranking", "grades"))
cte("list_zero", """SELECT r.query, r.item, coalesce(g.rel, 0) AS rel, row_number() OVER (PARTITION BY r.query ORDER BY score_a DESC, item) AS position
  FROM ranking r LEFT JOIN grades g USING (query, item)""", ("ranking", "grades"))


def _metrics_sql(name: str, digits: int = 4) -> str:
    def dcg(k):
        return f"coalesce(list_sum(list((pow(2, rel) - 1) / log2(position + 1) ORDER BY position) FILTER (position <= {k})), 0)"

    def idcg(k):
        return f"coalesce(list_sum(list((pow(2, rel) - 1) / log2(best + 1) ORDER BY best) FILTER (best <= {k})), 0)"
    return f"""
  SELECT query, n_ranked, {rx('n10', digits)} AS ndcg_10, {rx('n5', digits)} AS ndcg_5, {rx('p5', digits)} AS precision_5, {rx('m', digits)} AS mrr,
    {rx('r10', digits)} AS recall_10, n_labelled, n_relevant, {rx('c5', digits)} AS precision_5_ceiling
  FROM (SELECT query, count(*) AS n_ranked, CASE WHEN {idcg(10)} = 0 THEN 0 ELSE {dcg(10)} / {idcg(10)} END AS n10,
      CASE WHEN {idcg(5)} = 0 THEN 0 ELSE {dcg(5)} / {idcg(5)} END AS n5,
      count(*) FILTER (position <= 5 AND rel >= 2) / 5::DOUBLE AS p5,
      coalesce(1.0::DOUBLE / min(position) FILTER (rel >= 2), 0) AS m,
      CASE WHEN count(*) FILTER (rel >= 2) = 0 THEN 0 ELSE count(*) FILTER (rel >= 2 AND position <= 10) / (count(*) FILTER (rel >= 2))::DOUBLE END AS r10
    FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC) AS best FROM {name}) GROUP BY query)
  JOIN (SELECT query, count(*) AS n_labelled, count(*) FILTER (rel >= 2) AS n_relevant,
      least(count(*) FILTER (rel >= 2), 5) / 5::DOUBLE AS c5 FROM grades GROUP BY query) USING (query)"""


for _s in ("list_a", "list_b", "list_zero"):
    cte(f"metrics_{_s}", _metrics_sql(_s), (_s, "grades"))
    cte(f"raw_{_s}", _metrics_sql(_s, 9), (_s, "grades"))


def sql_mean(metric: str) -> str:
    return f"(sum(CAST(round_even({metric} * 1e9, 0) AS BIGINT))::DOUBLE / count(*) / 1e9::DOUBLE)"


def grades(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("query"))
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "query", F.col("doc_id").alias("item"),
        (F.col("quality") * 2 + 1 - F.col("toxic")).alias("rel"))


def ranking(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("lang").alias("query"), F.col("doc_id").alias("item"),
        F.col("n_chars").alias("score_a"), (F.col("doc_id") * 7919 % 1000).alias("score_b"))


def lists(spark, sf, system: str, condensed: bool = True):
    by = [F.desc(f"score_{system}"), F.col("item")]
    return ev.graded_lists(ranking(spark, sf), grades(spark, sf), by, condensed)


@shared
def lists_a(spark, sf):
    return lists(spark, sf, "a")


@shared
def lists_b(spark, sf):
    return lists(spark, sf, "b")


@shared
def metrics_a(spark, sf):
    return ev.query_metrics(lists_a(spark, sf), grades(spark, sf))


@shared
def metrics_b(spark, sf):
    return ev.query_metrics(lists_b(spark, sf), grades(spark, sf))


@query("eval_lists", """
  SELECT 'condensed' AS kind, query, item, rel, position FROM list_a
  UNION ALL SELECT 'zero_fill', query, item, rel, position FROM list_zero""", ("list_a", "list_zero"))
def eval_lists(spark, sf):
    cols = ["kind", "query", "item", "rel", "position"]
    zero = lists(spark, sf, "a", condensed=False)
    return lists_a(spark, sf).withColumn("kind", F.lit("condensed")).select(*cols).unionByName(
        zero.withColumn("kind", F.lit("zero_fill")).select(*cols))


@query("ndcg_at_k", "SELECT query, ndcg_5, ndcg_10 FROM metrics_list_a", ("metrics_list_a",))
def ndcg_at_k(spark, sf):
    found = ev.ndcg(lists_a(spark, sf), [5, 10], ["query"])
    return found.select("query", *[round_exact(F.col(c), 4).alias(c) for c in ("ndcg_5", "ndcg_10")])


@query("precision_at_k", "SELECT query, n_relevant, precision_5, precision_5_ceiling FROM metrics_list_a", ("metrics_list_a",))
def precision_at_k(spark, sf):
    return metrics_a(spark, sf).select("query", "n_relevant", "precision_5", "precision_5_ceiling")


@query("mrr", "SELECT query, mrr FROM metrics_list_a", ("metrics_list_a",))
def mrr(spark, sf):
    return lists_a(spark, sf).groupBy("query").agg(round_exact(ev.reciprocal_rank(), 4).alias("mrr"))


@query("recall_at_k", "SELECT query, recall_10 FROM metrics_list_a", ("metrics_list_a",))
def recall_at_k(spark, sf):
    return lists_a(spark, sf).groupBy("query").agg(round_exact(ev.recall(10), 4).alias("recall_10"))


_M = ["ndcg_10", "ndcg_5", "precision_5", "mrr", "recall_10"]


def raw_metrics(spark, sf):
    """Metrics per query and system, not yet rounded for display."""
    found = {"a": lists_a(spark, sf), "b": lists_b(spark, sf),
             "zero": lists(spark, sf, "a", condensed=False)}
    return {s: ev.query_metrics(rows, grades(spark, sf), digits=9).withColumn("system", F.lit(s))
            for s, rows in found.items()}


@query("eval_macro", " UNION ALL ".join(
    f"SELECT '{s}' AS system, n AS n_queries, " + ", ".join(f"{rx(m, 4)} AS {m}" for m in _M)
    + " FROM (SELECT count(*) AS n, " + ", ".join(f"{sql_mean('r.' + m)} AS {m}" for m in _M)
    + f" FROM raw_list_{s} r)" for s in ("a", "b", "zero")),
    ("raw_list_a", "raw_list_b", "raw_list_zero"))
def eval_macro(spark, sf):
    parts = raw_metrics(spark, sf)
    return ev.macro(parts["a"].unionByName(parts["b"]).unionByName(parts["zero"]), _M, ["system"])


_DRAW = "('0x' || substr(md5('{s}|' || draw || '|' || query || '|' || slot), 1, 7))::BIGINT % n".format(s=SEED)
cte("deltas_sql", f"""
  SELECT draw, avg_d / 1e9::DOUBLE AS delta FROM (SELECT draw, sum(d)::DOUBLE / count(*) AS avg_d FROM (
    SELECT query, draw, CAST(round_even((CASE WHEN max(i) = 0 THEN 0 ELSE max(b) / max(i) - max(a) / max(i) END) * 1e9, 0) AS BIGINT) AS d FROM (
      SELECT query, draw, list_sum(list(g / log2(ra + 1) ORDER BY ra) FILTER (ra <= 10)) AS a,
        list_sum(list(g / log2(rb + 1) ORDER BY rb) FILTER (rb <= 10)) AS b, list_sum(list(g / log2(ri + 1) ORDER BY ri) FILTER (ri <= 10)) AS i FROM (
        SELECT s.query, draw, pow(2, rel) - 1 AS g, row_number() OVER (PARTITION BY s.query, draw ORDER BY pos_a) AS ra,
          row_number() OVER (PARTITION BY s.query, draw ORDER BY pos_b) AS rb, row_number() OVER (PARTITION BY s.query, draw ORDER BY rel DESC) AS ri
        FROM (SELECT query, draw, {_DRAW} AS no FROM (SELECT query, no AS slot, count(*) OVER (PARTITION BY query) AS n FROM items),
            (SELECT unnest(range(0, {DRAWS})) AS draw)) s JOIN items USING (query, no))
      GROUP BY query, draw) GROUP BY query, draw) GROUP BY draw)""", ("items",))
cte("items", """SELECT a.query, a.item, a.rel, a.position AS pos_a, b.position AS pos_b,
    row_number() OVER (PARTITION BY a.query ORDER BY a.item) - 1 AS no FROM list_a a JOIN list_b b USING (query, item)""",
    ("list_a", "list_b"))
_LO, _HI = int(fv.BOOTSTRAP_LOW * DRAWS) + 1, min(DRAWS - 1, int(fv.BOOTSTRAP_HIGH * DRAWS)) + 1
cte("interval_sql", f"SELECT {rx('lo', 4)} AS low, {rx('hi', 4)} AS high FROM (SELECT list_sort(list(delta))[{_LO}] AS lo, "
    f"list_sort(list(delta))[{_HI}] AS hi FROM deltas_sql)", ("deltas_sql",))


@shared
def interval(spark, sf):
    paired = ev.paired_positions(lists_a(spark, sf), lists_b(spark, sf))
    deltas = ev.bootstrap_deltas(paired, DRAWS, [F.col("item")])
    return ev.bootstrap_interval(deltas, DRAWS)


@query("bootstrap_ci", "SELECT low, high FROM interval_sql", ("interval_sql",))
def bootstrap_ci(spark, sf):
    return interval(spark, sf)


cte("query_deltas", f"SELECT query, {rx('d', 4)} AS delta FROM (SELECT query, b.ndcg_10 - a.ndcg_10 AS d "
    "FROM metrics_list_a a JOIN metrics_list_b b USING (query))", ("metrics_list_a", "metrics_list_b"))


def query_deltas(spark, sf):
    b = metrics_b(spark, sf).select("query", F.col("ndcg_10").alias("b"))
    return metrics_a(spark, sf).select("query", F.col("ndcg_10").alias("a")).join(b, "query").select(
        "query", round_exact(F.col("b") - F.col("a"), 4).alias("delta"))


@query("permutation_p", f"""
  , d AS (SELECT CAST(round_even(delta * 10000, 0) AS BIGINT) AS d, row_number() OVER (ORDER BY query) - 1 AS i FROM query_deltas),
  m AS (SELECT unnest(range(0, CAST(pow(2, (SELECT count(*) FROM d)) AS BIGINT))) AS mask),
  s AS (SELECT mask, sum(CASE WHEN (mask >> i) & 1 = 0 THEN d ELSE -d END) AS t FROM m, d GROUP BY mask)
  SELECT (SELECT count(*) FROM d) AS n_queries, {rx('p', 4)} AS p_one_sided, {rx('f', 4)} AS minimum_p FROM (
    SELECT count(*) FILTER (t >= (SELECT sum(d) FROM d)) / count(*)::DOUBLE AS p, 1 / count(*)::DOUBLE AS f FROM s)""", ("query_deltas",))
def permutation_p(spark, sf):
    return ev.sign_flip(query_deltas(spark, sf), "delta")


@query("query_deltas", "SELECT query, delta FROM query_deltas", ("query_deltas",))
def deltas_per_query(spark, sf):
    return query_deltas(spark, sf)


@query("eval_verdict", """
  SELECT n_queries, point, crosses_zero, signs_agree, direction, CASE WHEN crosses_zero THEN 'the interval holds zero' ELSE 'the interval excludes zero' END
    || '; signs ' || CASE WHEN signs_agree THEN 'agree' ELSE 'do not agree' END AS verdict
  FROM (SELECT count(*) AS n_queries, round_even(sum(CAST(round_even(delta * 10000, 0) AS BIGINT))::DOUBLE / count(*), 0) / 10000.0::DOUBLE AS point, (SELECT low <= 0 AND high >= 0 FROM interval_sql) AS crosses_zero,
    bool_and(delta > 0) OR bool_and(delta < 0) AS signs_agree, CASE WHEN avg(delta) > 0 THEN 'improvement' ELSE 'regression' END AS direction
    FROM query_deltas)""", ("query_deltas", "interval_sql"))
def eval_verdict(spark, sf):
    return ev.verdict(query_deltas(spark, sf), "delta", interval(spark, sf))


@query("worst_misses", f"""
  SELECT query, item, rel, position, ideal_position, {rx('l', 4)} AS loss FROM (SELECT *, (pow(2, rel) - 1) *
      (1.0::DOUBLE / log2(ideal_position + 1) - 1.0::DOUBLE / log2(position + 1)) AS l
    FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, item) AS ideal_position FROM list_a))
  WHERE l > 0 ORDER BY {rx('l', 4)} DESC, query, item LIMIT 10""", ("list_a",))
def worst_misses(spark, sf):
    return ev.worst_misses(lists_a(spark, sf), [F.desc("rel"), F.col("item")], 10).select(
        "query", "item", "rel", "position", "ideal_position", "loss")
