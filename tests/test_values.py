"""Costly columns worked out once per value, against the same columns worked out in every row."""

from pyspark.sql import functions as F

from matchloom import vocabulary as vocab
from matchloom.operators import skills as sk
from matchloom.operators import values as vl


def test_per_value_gives_each_row_its_columns_and_works_out_a_value_once(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"t{i % 3}") for i in range(30)], "id long, t string")
    seen = []

    def derive(df):
        seen.append(df.count())
        return df.withColumn("n", F.coalesce(F.length("t"), F.lit(-1)))

    got = vl.per_value(rows, ["t"], derive)
    assert seen == [3]
    assert sorted(got.collect()) == sorted(derive(rows).collect())


def test_many_values_are_worked_out_in_their_rows(spark, monkeypatch):
    monkeypatch.setattr(vl, "HELD_VALUES", 2)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "id long, t string")
    got = vl.per_value(rows, ["t"], lambda df: df.withColumn("n", F.length("t")))
    assert sorted(got.collect()) == sorted(rows.withColumn("n", F.length("t")).collect())


def test_canonical_lists_by_item_equal_those_by_row(spark):
    lists = [["React.js", "react", None, " "], None, [], ["K8s", "Postgres", "postgres", "Ｐython"], ["  "], ["node js", "\U0001f680"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "id long, s array<string>")
    aliases = vocab.alias_map()
    for raw_first in (False, True):
        by_row = rows.select("id", sk.canonical_list(F.col("s"), aliases, raw_first).alias("c"))
        by_item = sk.with_canonical(rows, "s", "c", aliases, raw_first).select("id", "c")
        assert sorted(by_item.collect()) == sorted(by_row.collect())


def test_evidence_is_the_same_with_few_and_with_many_texts(spark, monkeypatch):
    entries = spark.createDataFrame(
        [(1, 1, "A", 5, 0, "Used apache spark and go today", ["Python"]), (1, 2, None, 7, 3, None, []),
         (2, 3, "", 4, 1, "python", None), (3, 4, "B", 1, 1, "", ["dbt"])],
        "id long, ix long, company_name string, attributed long, age int, description string, skills_used array<string>")
    declared = spark.createDataFrame([(1, ["python", "apache spark", "go"]), (2, ["python"]), (3, [])], "id long, declared array<string>")
    few = sorted(sk.evidence(entries, declared).collect())
    monkeypatch.setattr(sk, "HELD_PAIRS", 0)
    assert len(few) == 4 and few == sorted(sk.evidence(entries, declared).collect())


def test_declared_skills_are_not_broadcast_with_their_evidence(spark, tmp_path):
    # Files of lists of few skills are far smaller than the lists are in memory, where 900,000 of them overran the driver.
    spark.createDataFrame([(i, ["python", "dbt", "go"]) for i in range(2000)], "id long, declared array<string>").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(i, i, "A", 5, 0, "python", ["dbt"], "B", ["go"]) for i in range(2000)], """id long, ix long, company_name string,
        attributed long, age int, description string, skills_used array<string>, school_name string, skills array<string>""").write.parquet(f"{tmp_path}/e")
    declared, rows = spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/e")
    found = sk.evidence(rows, declared, rows.select("id", "ix", "school_name", "skills"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [id" in plan and "BroadcastHashJoin [id" not in plan
    assert {(r.skill, r.source): r["count"] for r in found.groupBy("skill", "source").count().collect()} == {
        ("python", "description@A"): 2000, ("dbt", "skills_used@A"): 2000, ("go", "education@B"): 2000}
