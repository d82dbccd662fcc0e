"""Profiles end to end: reading, signals, scoring, the feed and the store."""

import json
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import feed as fd
from matchloom.operators import merge as mg
from matchloom.operators import requirements as rq
from matchloom.operators import scoring as sc
from matchloom.operators import signals as sg
from matchloom.sources import dims, jsonl
from matchloom.sources.store import Store, file_digests

PROFILES = [
    {"id": "P1", "headline": "Senior Software Engineer @ Razorpay | Python", "location": "Bengaluru",
     "is_open_to_work": "false", "skills": ["Python", "FastAPI", "Kafka", "Postgres"],
     "experience": [
         {"role": "Senior Software Engineer", "company_name": "Razorpay", "start_date": "2022-04-01",
          "is_current": True, "duration_months": "40",
          "description": "Own payments ledger service. 12k rps peak.",
          "skills_used": ["Python", "Kafka", "PostgreSQL"]},
         {"role": "Software Engineer", "company_name": "Freshworks", "start_date": "2019-07-01",
          "end_date": "2022-03-31", "is_current": "no", "duration_months": 32,
          "description": "Django services", "skills_used": "Python"}, "junk"]},
    {"id": "P2", "headline": "Transitioning to Data Science", "skills": [
        "Machine Learning", "PyTorch", "AutoCAD", None, " "],
     "experience": [{"role": "Design Engineer", "company_name": "Tata", "start_date": "2019-01-01",
                     "is_current": "yes", "description": "AutoCAD drawings, tolerance stack",
                     "skills_used": ["AutoCAD"]}]},
    {"id": "P3", "headline": None, "experience": None, "skills": None},
    {"id": "P4", "headline": "QA", "experience": [{"role": "Engineer", "start_date": "not-a-date"}]},
]


@pytest.fixture(scope="module")
def profiles(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "profiles.jsonl")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write("\n".join(json.dumps(p) for p in PROFILES) + "\n\n{broken\n")
    return jsonl.read_profiles(spark, path)


@pytest.fixture(scope="module")
def signals(profiles):
    people, entries, studies = jsonl.explode_profiles(profiles[0])
    made = sg.extract(people, entries, F.to_date(F.lit("2025-08-01")), education=studies)
    return {r["id"]: r for r in made.collect()}


def test_bad_lines_are_quarantined(profiles):
    good, bad = profiles
    assert good.count() == 4
    assert [r["_raw"] for r in bad.collect()] == ["{broken"]


def test_one_record_per_profile_with_known_codes(spark, signals):
    assert set(signals) == {"P1", "P2", "P3", "P4"}
    codes = spark.createDataFrame([(r["reason_codes"],) for r in signals.values()],
                                  "codes array<string>")
    assert sg.vocabulary_violations(codes, "codes").count() == 0
    assert all(0.05 <= r["confidence"] <= 0.99 for r in signals.values())


def test_class_score_arithmetic(signals):
    # 40 months now at 0.8, and 32 months decayed by 40 months at 0.8.
    row = signals["P1"]
    assert row["role_family"] == "backend"
    assert row["role_family_scores"]["backend"] == 43.85
    assert row["years_total"] == 6.0 and row["tenure_flag"] == "stable"
    assert row["core_skills"][:1] == ["python"]
    assert "fastapi" in row["claimed_skills_unverified"]


def test_claims_do_not_beat_history(signals):
    row = signals["P2"]
    assert row["role_family"] == "non_engineering"
    assert "headline_declares_transition" in row["reason_codes"]
    assert "zero_role_experience_despite_skill_claim" in row["reason_codes"]
    assert row["core_skills"] == ["autocad"]


def test_empty_and_bad_profiles_survive(signals):
    assert signals["P3"]["role_family"] == "non_engineering"
    assert "date_parse_failure" in signals["P4"]["extraction_flags"]


JOB = [("J1", "Senior Backend Engineer", "Bengaluru (hybrid)", 5.0, 9.0,
        ["Python", "FastAPI or Django", "PostgreSQL", "production ownership of a high-traffic service"],
        ["Kafka"], "senior backend engineer")]
JOB_DDL = ("job_id string, title string, location string, min_years double, max_years double, "
           "must_have array<string>, good_to_have array<string>, raw_query string")


def test_scores_and_codes_of_one_job(spark, profiles):
    people, entries, _ = jsonl.explode_profiles(profiles[0])
    jobs = rq.parse_jobs(spark.createDataFrame(JOB, JOB_DDL))
    made = sg.extract(people, entries, F.to_date(F.lit("2025-08-01")))
    shipped = sc.shipped_evidence(entries, sc.job_terms(jobs))
    rows = sc.score(sc.pairs(sc.candidates(made, shipped), jobs), sg.Rules())
    got = {r["id"]: r for r in rows.collect()}
    assert len(got) == 4
    first = got["P1"]
    assert first["score_breakdown"]["role_match"] == 30.0
    # Three must-haves in full and FastAPI claimed only.
    assert first["score_breakdown"]["skill_overlap"] == pytest.approx(18 * 3.3 / 4 + 7)
    assert "must_have_claimed_only:fastapi_or_django" in first["match_codes"]
    assert first["score_breakdown"]["location_fit"] == 8.0
    assert got["P2"]["missing_must_haves"] and got["P2"]["total"] <= 35
    codes = rows.select("match_codes")
    assert sg.vocabulary_violations(codes, "match_codes").count() == 0


def test_unresolved_job_is_refused(spark):
    odd = spark.createDataFrame([("J9", "Barista", "X", 1.0, 2.0, ["a"], [], "coffee")], JOB_DDL)
    with pytest.raises(Exception, match="no class for job J9"):
        rq.parse_jobs(odd).collect()


# --------------------------------------------------------------------- feed
FEED_DDL = ("entity string, field_group string, observed_at string, ordinal bigint, source string, "
            "value string")


def feed_of(spark, rows):
    df = spark.createDataFrame(rows, FEED_DDL)
    from matchloom.functions import hashing as hs
    return df.withColumn("hash", F.when(F.col("value").isNotNull(), hs.text_group_hash(F.col("value"))))


BASE = [("A", "headline", "Engineer", "2025-08-01"), ("A", "about", "x", "2025-08-01")]


def base_of(spark):
    from matchloom.functions import hashing as hs
    df = spark.createDataFrame(BASE, "entity string, field_group string, base_value string, base_at string")
    return df.withColumn("base_hash", hs.text_group_hash(F.col("base_value")))


ROWS = [
    ("A", "headline", "2026-01-02", 1, "s", "Staff"),
    ("A", "headline", "2026-01-01", 2, "s", "Older but newer than base"),
    ("A", "headline", "2025-01-01", 3, "s", "stale"),
    ("A", "headline", "2026-01-02", 4, "s", "same time"),
    ("A", "headline", "2026-01-03", 5, "s", " STAFF \U0001f680"),
    ("A", "about", "2026-01-03", 6, "s", None),
    ("A", "about", "", 7, "s", "no time"),
    ("N", "headline", "", 8, "s", "timeless new"),
    ("N", "about", "2026-01-01", 9, "s", None),
]


def test_feed_traps(spark):
    events = fd.apply_feed(feed_of(spark, ROWS), base_of(spark))
    got = {r["ordinal"]: r for r in events.where("field not like '\\\\_%'").collect()}
    assert {o: r["change"] for o, r in got.items()} == {
        1: "applied", 2: "applied", 3: "stale_skip", 4: "stale_skip", 5: "noise",
        6: "suspected_deletion", 7: "stale_skip", 8: "applied", 9: "suspected_deletion"}
    assert got[1]["old_value"] == "Older but newer than base"
    kinds = {(r["entity"], r["change_type"]) for r in events.collect()}
    assert ("N", "candidate_created") in kinds and ("A", "malformed_record") in kinds


def test_replay_changes_nothing(spark):
    feed, base = feed_of(spark, ROWS), base_of(spark)
    after = fd.next_state(fd.apply_feed(feed, base), base)
    again = fd.apply_feed(feed, after)
    material = again.where("materiality <> 'noise' and field = 'headline'")
    assert material.count() == 0
    second = fd.next_state(again, after)
    cols = ["entity", "field_group", "base_value", "base_hash", "base_at"]
    assert second.select(cols).exceptAll(after.select(cols)).count() == 0


def test_event_id_is_content_addressed(spark):
    row = spark.range(1).select(fd.event_id(
        F.lit("SDB_10001"), F.lit("2026-08-16T04:00:00Z"), F.lit("field_update"), F.lit("headline"),
        F.lit("Staff Engineer @ Razorpay | Python, FastAPI, Distributed Systems"))).first()
    assert row[0] == "evt_37542596d20e702f91cdc4"


ENTRY = ("role string, company_name string, start_date string, end_date string, is_current boolean, "
         "duration_months bigint, job_type string, work_type string, location string, "
         "description string, skills_used array<string>")


def entry(role, company, start, end=None, current=None, description=None, skills=None):
    return (role, company, start, end, current, None, None, None, None, description, skills or [])


def test_experience_changes_and_merge(spark):
    stored = [("A", *entry("SWE", "Zeta", "2020-01-01", None, True, "apis", ["Go"])),
              ("A", *entry("Intern", "Orbit", "2019-01-01", "2019-06-01", False))]
    base = spark.createDataFrame(stored, "entity string, " + ENTRY)
    records = [
        ("A", "t1", 1, [entry("SWE", "Zeta Pvt Ltd", "2020-01-01", None, True, "apis  \U0001f680", ["go"]),
                        entry("Intern", "Orbit", "2019-01-01", "2019-06-01", False)]),
        ("A", "t2", 2, [entry("SWE", "Zeta", "2020-01-01", "2024-01-01")]),
        ("A", "t3", 3, [entry("Lead", "Quark", "2024-02-01", None, True)]),
        ("A", "t4", 4, [entry("Lead", "Quark", "2024-02-01", None, True, "more")]),
    ]
    observed = spark.createDataFrame(
        records, f"entity string, observed_at string, ordinal bigint, entries array<struct<{ENTRY}>>")
    got = {r["observed_at"]: (r["change"], r["list_kind"])
           for r in mg.experience_changes(observed, base).collect()}
    assert got["t1"][0] == "noise"
    assert got["t2"] == ("applied", "current_role_ended")
    assert got["t3"] == ("applied", "new_role")
    assert got["t4"] == ("applied", "entry_updated")
    rows = base.withColumn("ord", F.lit(0)).unionByName(observed.select(
        "entity", F.col("ordinal").cast("int").alias("ord"), F.explode("entries").alias("e")).select(
        "entity", "ord", "e.*"))
    rows = rows.select("*", *mg.entry_key(F.col("company_name"), F.col("start_date")))
    merged = {r["company_key"]: r for r in mg.merge_by_key(
        rows, ["entity", "company_key", "start_key"], ["ord"], mg.ENTRY_FIELDS,
        ["company_name"]).collect()}
    assert set(merged) == {"zeta", "orbit", "quark"}
    assert merged["zeta"]["end_date"] == "2024-01-01" and merged["zeta"]["skills_used"] == ["go"]
    assert merged["quark"]["description"] == "more"


def test_store_versions_and_ledger(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    store.upsert(rows, "t", ["k"], ["t"], "r1", "2026-01-01")
    store.upsert(spark.createDataFrame([(1, "z", 2)], rows.schema), "t", ["k"], ["t"], "r2", "x")
    assert {(r["k"], r["v"]) for r in store.read("t").collect()} == {(1, "z"), (2, "b")}
    assert store.ledger().count() == 2 and store.latest("t") == 2
    store.append(rows, "log", "k", ["t"], "r3", "x")
    store.append(rows, "log", "k", ["t"], "r4", "x")
    assert store.read("log").count() == 2


def test_dictionaries_are_checked(spark, tmp_path):
    path = tmp_path / "titles.json"
    path.write_text(json.dumps({"backend": ["API Engineer", "shared"], "qa": ["shared"]}))
    dim = dims.load_dictionary(spark, str(path), "family", "pattern")
    assert [r["pattern"] for r in dims.conflicts(dim, "pattern", "family").collect()] == ["shared"]
    with pytest.raises(ValueError, match="conflict"):
        dims.refuse_rows(dims.conflicts(dim, "pattern", "family"), "conflict")
    first = {r["pattern"]: r["family"] for r in dims.first_wins(
        dim, "pattern", "family", "ordinal").collect()}
    assert first["shared"] == "backend"
    assert file_digests(spark, str(path)).first()["digest"].startswith("sha256:")


def test_readers_and_ordered_writer(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps([{"job_id": "J1", "must_have": ["a"], "min_years": 2}]))
    (tmp_path / "labels.csv").write_text("job_id,candidate_id,relevance,graded_by,graded_on\nJ1,C1,3,x,2026-01-01\n")
    assert jsonl.read_jobs(spark, str(tmp_path / "jobs.json")).first()["must_have"] == ["a"]
    assert jsonl.read_labels(spark, str(tmp_path / "labels.csv")).first()["relevance"] == 3
    jsonl.write_json(spark.range(50).select((50 - F.col("id")).alias("n")), str(tmp_path / "out"), ["n"])
    assert spark.read.json(str(tmp_path / "out")).count() == 50


def test_feed_reader_tells_absent_from_null(spark, tmp_path):
    path = tmp_path / "feed.jsonl"
    path.write_text(json.dumps({"id": "A", "_observed_at": "2026", "about": None, "skills": ["x"]}) + "\n")
    feed, _ = jsonl.read_feed(spark, str(path))
    rows = {r["field_group"]: r["value"] for r in fd.explode_profiles(feed).collect()}
    assert rows == {"about": None, "skills": '["x"]'}


def test_stream_equals_batch(spark, tmp_path):
    from matchloom.streaming import feed as st
    rows = [("N", "headline", f"2026-01-0{i}", i, "s", v) for i, v in enumerate(
        ["a", "A ", "b", None, "b", "c"], start=1)]
    feed = feed_of(spark, rows)
    path = str(tmp_path / "feed")
    feed.coalesce(1).write.parquet(path)
    out = st.run_available(spark, st.stream_changes(
        spark.readStream.schema(feed.schema).parquet(path)), "test_stream")
    empty = base_of(spark).limit(0)
    batch = fd.mark_changes(fd.mark_stale(feed, empty))
    cols = ["ordinal", "change", "old_value"]
    assert out.select(cols).exceptAll(batch.select(cols)).count() == 0 and out.count() == 6


def test_stream_with_a_base_in_several_batches(spark, tmp_path):
    """Two micro-batches over a base load give what one batch application gives."""
    from matchloom.streaming import feed as st
    rows = [("A", g, f"2026-01-{d:02d}", i, "s", v) for i, (g, d, v) in enumerate([
        ("headline", 1, "old title"), ("headline", 3, "x"), ("headline", 3, "y"), ("headline", 4, None),
        ("about", 2, None), ("about", 3, "text"), ("about", 3, "again"),
        ("headline", 6, "X"), ("headline", 7, "z"), ("about", 8, "Text "), ("about", 9, None), ("location", 9, "here")])]
    feed = feed_of(spark, rows).withColumn("file", F.when(F.col("ordinal") < 7, 0).otherwise(1))
    path = str(tmp_path / "feed")
    for part in (0, 1):
        feed.where(F.col("file") == part).drop("file").coalesce(1).write.mode("append").parquet(path)
    feed = feed.drop("file")
    base = feed.where("ordinal in (0, 11)").select(
        "entity", "field_group", F.col("value").alias("base_value"), F.col("hash").alias("base_hash"),
        F.lit("2026-01-02").alias("base_at"))
    source = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = st.run_available(spark, st.stream_changes(source, base), "test_stream_base")
    batch = fd.mark_changes(fd.mark_stale(feed, base))
    cols = ["ordinal", "change", "old_value"]
    assert out.count() == 12 and out.select(cols).exceptAll(batch.select(cols)).count() == 0


def test_batches_of_a_backlog_with_a_hot_field(spark, tmp_path):
    """A field with a third of all rows, in several micro-batches with late records: equal to the stateful
    operator on the same batches, and to one batch application where no record is late."""
    from matchloom.streaming import feed as st
    rng = random.Random(6)
    rows = []
    for i in range(600):
        key = ("hot", "headline") if i % 3 else (f"e{rng.randrange(20)}", rng.choice(["about", "location"]))
        rows.append((*key, f"2026-01-{1 + i // 30:02d}T{rng.randrange(24):02d}", i, "s", rng.choice([None, "a", "A ", "b", "c"])))
    late = [("hot", "headline", "2026-01-02T00", 700, "s", "late"), ("new", "about", "2026-01-01T00", 701, "s", None)]
    base = feed_of(spark, [("hot", "headline", "2025", 0, "s", "zero"), ("e1", "about", "2025", 1, "s", "a")]).select(
        "entity", "field_group", F.col("value").alias("base_value"), F.col("hash").alias("base_hash"),
        F.lit("2026-01-03T05").alias("base_at"))
    cols = ["entity", "field_group", "ordinal", "change", "old_value"]
    for extra in ([], late):
        path = str(tmp_path / f"feed{len(extra)}")
        whole = rows + extra
        for part in (rows[:210], rows[210:390], rows[390:] + extra):
            feed_of(spark, part).coalesce(1).write.mode("append").parquet(path)
        schema = feed_of(spark, whole).schema
        root = str(tmp_path / f"root{len(extra)}")
        out = st.run_batches(spark, st.admitted(spark, path, schema, 1), "t", base, root)
        assert len(list((tmp_path / f"root{len(extra)}" / "changes").glob("batch=*"))) == 3
        stateful = st.run_available(spark, st.stream_changes(st.admitted(spark, path, schema, 1), base), "t")
        assert out.count() == len(whole) and out.select(cols).exceptAll(stateful.select(cols)).count() == 0
        if not extra:
            # The days of the parts do not overlap, so one application of all rows gives the same.
            batch = fd.mark_changes(fd.mark_stale(feed_of(spark, whole), base))
            assert out.select(cols).exceptAll(batch.select(cols)).count() == 0
            assert out.where("entity = 'hot'").count() == 400
        # A batch that comes again changes nothing; one whose state was lost writes the same changes again.
        before = sorted(map(tuple, out.collect()), key=str)
        st.batch_sink(root, base)(feed_of(spark, rows[:210]), 0)
        assert sorted(map(tuple, out.collect()), key=str) == before
        runs = tmp_path / f"root{len(extra)}" / "state" / "_runs"
        last = max(p.name for p in runs.iterdir() if p.name.startswith("fields"))
        (runs / last).rename(tmp_path / f"lost{len(extra)}")
        st.batch_sink(root, base)(feed_of(spark, rows[390:] + extra), 2)
        assert sorted(map(tuple, spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(
            f"{root}/changes").collect()), key=str) == before


def test_event_ids_of_typed_values(spark):
    """Ids depend on the JSON form of the value: a flag, a list of words, a list of entries in one line each, text."""
    at = "2026-08-16T04:00:00Z"
    entries = ('[{"role":"Backend Engineer","company_name":"Jupiter","start_date":"2025-11-01","end_date":null},'
               '{"role":"Backend Engineer","company_name":"Paytm","start_date":"2017-06-01","end_date":"2023-03-31"}]')
    rows = [("SDB_10002", "field_update", "is_open_to_work", "false", "evt_e75b1c79e760b68a78c2ca"),
            ("SDB_10009", "field_update", "is_open_to_work", "true", "evt_66344384048c8b76bfc2de"),
            ("SDB_10009", "stale_skip", "is_open_to_work", "true", "evt_87a8b8e1f8a8249ad119a9"),
            ("SDB_10025", "field_update", "experience", entries, "evt_488d8a33afd81f165d65d2"),
            ("SDB_10025", "suspected_deletion", "about", None, "evt_5d6ec39c3730df8c8a3cb6"),
            ("SDB_10024", "field_update", "location", "Berlin, Germany", "evt_825b17a45e915da1732fa7")]
    df = spark.createDataFrame(rows, "e string, kind string, field string, value string, want string")
    got = df.select("want", fd.event_id(F.col("e"), F.lit(at), F.col("kind"), F.col("field"), F.col("value")).alias("id"))
    assert [r["id"] for r in got.collect()] == [r[4] for r in rows]


def test_ranks_on_text_ids_and_classes_outside_the_table(spark, profiles):
    people, entries, _ = jsonl.explode_profiles(profiles[0])
    jobs = rq.parse_jobs(spark.createDataFrame(JOB * 1, JOB_DDL))
    made = sg.extract(people, entries, F.to_date(F.lit("2025-08-01")))
    strange = made.withColumn("role_family", F.when(F.col("id") == "P2", "quant").otherwise(F.col("role_family")))
    shipped = sc.shipped_evidence(entries, sc.job_terms(jobs))
    rows = sc.score(sc.pairs(sc.candidates(strange, shipped), jobs), sg.Rules())
    ranked = sc.rank_matches(rows, ["job_id"]).select("id", "total", "confidence", "rank").collect()
    want = sorted(ranked, key=lambda r: (-r["total"], -r["confidence"], r["id"]))
    assert [r["rank"] for r in want] == [1, 2, 3, 4] and {r["id"] for r in want} >= {"P1", "P2"}


def test_terms_and_classes_have_no_cap(spark):
    words = [f"term{i:05d}" for i in range(25_000)]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    entries = spark.createDataFrame([(1, 0, "built xterm00007y and term24999 for 10 users"), (2, 0, None)],
                                    "id bigint, ix bigint, description string")
    got = {r["id"]: sorted(r["term_hits"]) for r in sc.shipped_evidence(entries, terms).collect()}
    assert got == {1: ["term00007", "term24999"], 2: []}
    from matchloom.operators import classify as cl
    import math
    cents = spark.createDataFrame([(f"c{i:04d}", [math.cos(i / 5000), math.sin(i / 5000)]) for i in range(5000)],
                                  "label string, centroid array<double>")
    vectors = spark.createDataFrame([(1, [2.0, 0.0]), (2, [math.cos(0.5), math.sin(0.5)]), (3, [0.0, 0.0])],
                                    "id bigint, v array<double>")
    found = {r["id"]: r["predicted"] for r in cl.nearest_centroid(vectors, "v", cents, "id").collect()}
    assert found == {1: "c0000", 2: "c2500", 3: None}


def data_rows(store, table, version):
    """Rows that the files of one version hold."""
    run = next(r for r in store._runs(table) if r["version"] == version)
    return store.spark.read.parquet(store._path(run)).count()


def test_store_writes_what_is_fresh_and_merges_in_tiers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), fan=3)
    rows = spark.createDataFrame([(i, f"v{i}", 1) for i in range(40)], "k bigint, v string, t bigint")
    store.upsert(rows, "t", ["k"], ["t"], "r1", "x")
    later = rows.where("k in (7, 9)").withColumns({"v": F.lit("new"), "t": F.lit(2).cast("bigint")})
    version = store.upsert(later, "t", ["k"], ["t"], "r2", "x", "d")
    second = store.ledger().where(F.col("version") == version).first()
    assert (second["kind"], second["digests"], data_rows(store, "t", version)) == ("upsert", "d", 2)
    got = {r["k"]: r["v"] for r in store.read("t").collect()}
    assert len(got) == 40 and got[7] == got[9] == "new" and got[8] == "v8"
    # An older row loses, an equally new one wins; the third run makes a merge fall due.
    store.upsert(spark.createDataFrame([(7, "old", 0), (8, "same", 1)], rows.schema), "t", ["k"], ["t"], "r3", "x")
    assert [(r["tier"], r["replaces"]) for r in store.live("t")] == [(1, "1,2,3")]
    got = {r["k"]: r["v"] for r in store.read("t").collect()}
    assert (got[7], got[8], len(got)) == ("new", "same", 40)
    # Snapshots before the merge stay exact.
    assert {r["k"]: r["v"] for r in store.read("t", 1).collect()}[7] == "v7"
    assert {r["k"]: r["v"] for r in store.read("t", 2).collect()}[8] == "v8"
    for run in ("r5", "r6"):
        store.append(rows.where("k < 10").withColumn("k", F.col("k") + 35), "t", "k", ["t"], run, "x")
    assert store.read("t").count() == 45 and [data_rows(store, "t", v) for v in (5, 6)] == [5, 0]
    assert store.read("t").where("k = 7").first()["v"] == "new" and store.read("t").columns == ["k", "v", "t"]
    store.compact("t", ["k"], "r7", "x")
    assert store.read("t").count() == 45 and len(store.paths("t")) == 1
    assert store.vacuum("t") == 6 and store.read("t").count() == 45
    assert store.read("none") is None and store.compact("none", ["k"], "r", "x") is None


def test_store_rewrites_a_row_once_a_tier(spark, tmp_path):
    """Equal to a dictionary after many spread-out upserts, with rows written in proportion to rows given."""
    rng = random.Random(4)
    store, want, given = Store(spark, str(tmp_path / "s"), fan=3), {}, 0
    for n in range(9):
        rows = [(rng.randrange(60), f"{n}-{i}", n) for i in range(20)]
        rows = list({k: (k, v, t) for k, v, t in rows}.values())
        want |= {k: v for k, v, _ in rows}
        given += len(rows)
        store.upsert(spark.createDataFrame(rows, "k bigint, v string, t bigint"), "t", ["k"], ["t"], f"r{n}", "x")
    assert {r["k"]: r["v"] for r in store.read("t").collect()} == want
    written = sum(data_rows(store, "t", r["version"]) for r in store._runs("t"))
    assert written <= 3 * given and [r["tier"] for r in store.live("t")] == [2]
