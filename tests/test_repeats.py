"""Titles that repeat are worked out once each, with the results of reading every row."""

from matchloom.operators import classify as cl
from matchloom.operators import training as tr


def counted(monkeypatch, module):
    seen, whole = [], module.per_value
    monkeypatch.setattr(module, "per_value", lambda df, keys, derive: seen.append(keys) or whole(df, keys, derive))
    return seen


def test_predictions_of_titles_that_repeat(spark, monkeypatch):
    rows = [("steel lamp", "a"), ("steel lamps", "a"), ("brass horn", "b"), ("brass horns", "b"), ("", "b")]
    corpus = tr.corpus_rows(spark.createDataFrame(rows, "core string, label string"), "core", "label")
    model = tr.train(corpus)
    seen = counted(monkeypatch, tr)
    many = spark.createDataFrame([(k, [*(r[0] for r in rows), None][k % 6]) for k in range(60)], "id long, core string")
    got = tr.predict(many.where("core is not null"), "core", model).collect()
    assert seen == [["core"]] and len(got) == 50
    alone = {r.core: (r.forced, r.probability, r.fallback) for core, _ in rows
             for r in tr.predict(spark.createDataFrame([(core,)], "core string"), "core", model).collect()}
    assert all((r.forced, r.probability, r.fallback) == alone[r.core] for r in got)


def test_titles_that_repeat(spark, monkeypatch):
    seen = counted(monkeypatch, cl)
    rows = spark.createDataFrame([(k, ["Sr. Data Scientist", None, ""][k % 3]) for k in range(9)], "id long, t string")
    got = cl.with_title(rows, "t").orderBy("id").collect()
    assert seen == [["t"]] and [r.id for r in got] == list(range(9))
    assert len({r.core for r in got if r.t}) == 1 and all(r.core == "" for r in got if not r.t)
