"""What an entity and the demand of a job decide is worked out once, whatever the number of jobs and entries."""

from pyspark.sql import functions as F

from matchloom.operators import scoring as sc
from matchloom.operators.signals import Rules


def test_jobs_that_agree_share_what_is_derived(spark):
    people = spark.range(7).select("id")
    jobs = spark.range(600).select(F.col("id").alias("job_id"), (F.col("id") % 2).cast("string").alias("job_family"))
    made = sc.beside_demands(people, jobs, ["job_family"], lambda df: df.withColumn("drawn", F.uuid()))
    rows = made.groupBy("id", "job_family").agg(F.count_distinct("job_id").alias("jobs"), F.count_distinct("drawn").alias("drawn")).collect()
    assert len(rows) == 14 and all(r.jobs == 300 for r in rows)
    # 600 jobs are cut into lists of about 256: at most three for each demand.
    assert all(r.drawn <= 3 for r in rows)


def test_score_of_shared_demands_is_that_of_pairs(spark):
    rules = Rules()
    people = spark.createDataFrame(
        [(1, "backend", ["data_engineer"], ["backend"], [("backend", 40)], ["python"], ["kafka"], 0.4, "stable", "pune", 0.9, [], "ran 3 services", ["platform"]),
         (2, "qa", [], [], [], [], ["python"], 0.1, "hopper", "", 0.3, [], None, [])],
        "id long, role_family string, role_family_alt array<string>, priors array<string>, history array<struct<family:string,months:bigint>>, "
        "core_skills array<string>, claimed_skills_unverified array<string>, switch_intent_p double, tenure_flag string, location_text string, "
        "confidence double, reason_codes array<string>, snippet string, term_hits array<string>")
    need = "struct<raw:string,kind:string,alternatives:array<string>,terms:array<string>,label:string>"
    must = [("Python", "skill", ["python"], [], "python"), ("platform at scale", "evidence", [], ["platform"], "platform_at_scale")]
    rows = [(k, ["backend", "data_engineer"][k % 2], float(k % 4), float(k % 4 + 3), must[:1 + k % 2], [("Kafka", "skill", ["kafka"], [], "kafka")] * (k % 3),
             ["pune", "", "delhi"][k % 3], k % 5 == 0) for k in range(40)]
    jobs = spark.createDataFrame(rows, "job_id long, job_family string, min_years double, max_years double, "
                                 f"must_have array<{need}>, good_to_have array<{need}>, city string, is_remote boolean")
    for on in (None, sc.switches(sc.RUNGS[2])):
        old = sc.score(sc.pairs(people, jobs), rules, on)
        new = sc.score_pairs(people, jobs, rules, on).select(*old.columns)
        assert sorted(map(str, old.collect())) == sorted(map(str, new.collect())) and new.count() == 80


def test_descriptions_that_repeat_are_read_once(spark, monkeypatch):
    seen = []
    whole = sc.per_value
    monkeypatch.setattr(sc, "per_value", lambda df, keys, derive: seen.append(keys) or whole(df, keys, derive))
    entries = spark.range(3000).select(
        (F.col("id") % 50).alias("id"), F.col("id").alias("ix"),
        F.get(F.array(F.lit("Led the platform team"), F.lit("  Built 3 services "), F.lit(None), F.lit("")), (F.col("id") / 50).cast("int") % 4).alias("description"))
    terms = spark.createDataFrame([("platform",), ("serv",), ("absent",)], "term string")
    got = {r.id: (r.snippet, sorted(r.term_hits)) for r in sc.shipped_evidence(entries, terms).collect()}
    assert seen == [["description"]] and len(got) == 50
    assert set(map(str, got.values())) == {str(("Led the platform team", ["platform", "serv"]))}
