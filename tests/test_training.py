"""The trained title classifier: its weights by hand, and its predictions from the published table."""

import hashlib
import math
import random

import pytest

from matchloom.operators import training as tr
from pyspark.sql import functions as F

NOUNS = {"ops": ["pager", "cluster", "rollout"], "data": ["tables", "pipelines", "metrics"], "web": ["pages", "forms", "styles"]}


def corpus(spark, n=90):
    rng = random.Random(1)
    rows = [(" ".join([rng.choice(["senior", "junior", "lead", "a"]), rng.choice(words), rng.choice(["person", "expert", "hand"])]), label)
            for _ in range(n // 3) for label, words in NOUNS.items()]
    return tr.corpus_rows(spark.createDataFrame(rows, "core string, label string"), "core", "label")


def bucket(gram, bits):
    return int(hashlib.md5(gram.encode()).hexdigest()[:6], 16) & ((1 << bits) - 1)


def by_hand(title, titles, bits):
    def blocks(t):
        words = t.split(" ")
        kept = [w for w in words if len(w) > 1]
        grams = [f" {w} "[i:i + n] for n in (3, 4, 5) for w in words for i in range(max(1, len(w) + 3 - n))]
        return [[bucket(g, bits) for g in grams], [bucket(g, bits) for g in kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]]]
    out = {}
    for k, own in enumerate(blocks(title)):
        values = {}
        for b in set(own):
            df = sum(b in blocks(t)[k] for t in titles)
            values[b] = (1 + math.log(own.count(b))) * (math.log((1 + len(titles)) / (1 + df)) + 1)
        norm = math.sqrt(sum(v * v for v in values.values()))
        out |= {b + (k << bits): v / norm for b, v in values.items()}
    return out


@pytest.mark.parametrize("bits", [4, 13])
def test_features_by_hand(spark, bits):
    titles = ["senior data data data person", "lead web", "a", "", "x y z", "écran naïf"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "core string, value_ int")
    rows = tr.feature_rows(df, "core", tr.weigh(df, "core", bits)).collect()
    for i, title in enumerate(titles):
        got = {r.feature: r.value for r in rows if r.value_ == i}
        want = by_hand(title, titles, bits)
        assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-12 for f in want)


def test_predictions_from_the_published_table(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = corpus(spark)
    model = tr.train(rows)
    asked = rows.select("core").union(spark.createDataFrame([("unknown words",), ("",), ("lead pages pager",)], "core string"))
    asked = asked.distinct()
    got = {r.core: r for r in tr.predict(asked, "core", model).collect()}
    con = duckdb.connect()
    con.register("f", tr.feature_rows(asked, "core", model.weights).toPandas())
    con.register("c", tr.coefficients(spark, model).toPandas())
    con.register("asked", asked.toPandas())
    want = con.execute("""
      WITH scores AS (
        SELECT a.core, i.label, i.weight + coalesce((SELECT sum(f.value * c.weight) FROM f JOIN c USING (feature)
          WHERE f.core = a.core AND c.label = i.label), 0) AS z FROM asked a, c i WHERE i.feature = -1)
      SELECT core, arg_max(label, z) AS label, 1 / sum(exp(z - top)) AS p
      FROM (SELECT *, max(z) OVER (PARTITION BY core) AS top FROM scores) GROUP BY core""").fetchall()
    assert len(want) == len(got)
    for core, label, p in want:
        assert abs(got[core].probability - p) < 1e-9 and (got[core].forced == label or p < 0.34)
        assert (got[core].fallback is not None) == (p >= 0.45 and core != "")
    right = tr.predict(rows, "core", model).where(F.col("forced") == F.col("label")).count()
    assert right == rows.count()
