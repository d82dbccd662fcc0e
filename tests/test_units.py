"""Hand-made cases for functions and operators."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom import vocabulary as vocab
from matchloom.functions import coerce as co
from matchloom.functions import dates, hashing, text
from matchloom.functions.numeric import round_exact
from matchloom.operators import classify as cl
from matchloom.operators import evaluate as ev
from matchloom.operators import skew
from matchloom.operators import spans as sp


def column(spark, values, expr, ddl="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + ddl)
    return [r[0] for r in rows.orderBy("i").select(expr.alias("x")).collect()]


def test_norm_text_folds_case_blanks_emoji_and_compatibility(spark):
    got = column(spark, ["  Ａｂ\t C \U0001f680", "Straße", None, "é​x", "ΣΑΣ"],
                 text.norm_text(F.col("v")))
    assert got == ["ab c", "strasse", "", "éx", "σασ"]


def test_norm_title_splits_levels(spark):
    got = column(spark, ["SDE-3 | Python", "Senior ML Engineer @ X", "Software Engineer II",
                         "Lead at Zeta", "Senior"], text.norm_title(text.norm_text(F.col("v"))))
    assert [(r["core"], r["prefixes"]) for r in got] == [
        ("sde", ["3"]), ("ml engineer", ["senior"]), ("software engineer", ["ii"]),
        ("lead", ["lead"]), ("senior", ["senior"])]


def test_norm_skill_aliases_and_suffixes(spark):
    table = text.literal_map(vocab.alias_map())
    got = column(spark, ["React.js", "node js", "K8s", "JS", "(Redis)", "three.js", "Next.js"],
                 text.norm_skill(text.norm_text(F.col("v")), table))
    assert got == ["react", "node.js", "kubernetes", "javascript", "redis", "three", "next.js"]


def test_coercion_never_raises(spark):
    values = ["1,234", " 42.9 ", "junk", "", None, "true", "-7"]
    assert column(spark, values, co.to_int(F.col("v"))) == [1234, 42, None, None, None, None, -7]
    assert column(spark, ["Yes", "0", "n", "maybe", None], co.to_bool(F.col("v"))) == [
        True, False, False, None, None]


def test_dates(spark):
    got = column(spark, ["2020-1-5", "2020/01/05", "05-01-2020", "2020-01", "2020",
                         "2020-01-05T10:00:00Z", "not-a-date", "2020-13-01", None],
                 dates.parse_date(F.col("v")))
    day = dt.date(2020, 1, 5)
    first = dt.date(2020, 1, 1)
    assert got == [day, day, day, first, first, day, None, None, None]
    pair = spark.createDataFrame([(dt.date(2020, 1, 31), dt.date(2020, 2, 29))], "a date, b date")
    assert pair.select(dates.whole_months(F.col("a"), F.col("b"))).first()[0] == 0


def test_round_exact_matches_python(spark):
    rng = random.Random(1)
    values = [1.005, 2.675, 2.5, 0.125, 1.495, 0.025, -1.005, 3.0] + [
        rng.randrange(100_000) / 200 for _ in range(500)]
    got = column(spark, values, round_exact(F.col("v"), 2), "v double")
    assert got == [round(v, 2) for v in values]


def test_hash_ignores_order_and_emoji_but_not_removal(spark):
    rows = spark.createDataFrame([(["Python", "Kafka"],), (["Kafka", "Python"],), (["Kafka"],)],
                                 "s array<string>")
    a, b, c = [r[0] for r in rows.select(hashing.group_hash("skills", F.col("s"))).collect()]
    assert a == b != c
    x, y = column(spark, ["ML Engineer | Serving", "ML Engineer  | Serving \U0001f680"],
                  hashing.group_hash("headline", F.col("v")))
    assert x == y


def lexicon_result(spark, title, context=""):
    df = spark.createDataFrame([(title, context)], "role string, ctx string")
    df = cl.with_title(df, "role").withColumn("ctx", text.norm_text(F.col("ctx")))
    return cl.classify(df, "core", "ctx").first()["cls"]


def test_ambiguous_titles_abstain_without_context(spark):
    titles = ["Engineer", "Developer", "Consultant", "Member of Technical Staff",
              "Design Engineer", "SDE"]
    df = spark.createDataFrame([(t, "") for t in titles], "role string, ctx string")
    out = cl.classify(cl.with_title(df, "role"), "core", "ctx")
    assert out.where("cls is not null").count() == 0


def test_context_decides_ambiguous_title(spark):
    got = lexicon_result(spark, "Design Engineer", "AutoCAD SolidWorks tolerance stack")
    assert (got["family"], got["confidence"]) == ("non_engineering", 0.8)
    assert lexicon_result(spark, "MLE")["confidence"] == 1.0
    assert lexicon_result(spark, "Lead QA Engineer - Payments")["family"] == "qa"


def brute_attribution(rows):
    def months(a, b):
        return max(0, (b.year - a.year) * 12 + b.month - a.month - (b.day < a.day))
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == key], key=lambda r: (r[2], r[3]), reverse=True)
        seen = []
        for _, ix, s, e in mine:
            lost = sum(months(max(s, a), min(e, b)) for a, b in seen if min(e, b) > max(s, a))
            out[(key, ix)] = max(0, months(s, e) - lost)
            seen.append((s, e))
    return out


def test_attribution_matches_brute_force(spark):
    rng = random.Random(7)
    base = dt.date(2010, 1, 31)
    rows = []
    for i in range(120):
        start = base + dt.timedelta(days=rng.randrange(1200))
        rows.append((i % 6 if i % 3 else 0, i, start, start + dt.timedelta(days=rng.randrange(900))))
    df = spark.createDataFrame(rows, "id bigint, ix bigint, start_on date, end_on date").withColumn(
        "months", dates.whole_months(F.col("start_on"), F.col("end_on")))
    got = {(r["id"], r["ix"]): r["attributed"]
           for r in sp.attributed_months(df).collect()}
    assert got == brute_attribution(rows)


@pytest.mark.parametrize("sweep", [1, 40, 1 << 15])
def test_attribution_over_batches_with_hot_and_small_entities(spark, monkeypatch, sweep):
    monkeypatch.setattr(sp, "_SWEEP", sweep)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rng = random.Random(11)
        base = dt.date(1999, 12, 25)
        rows = []
        for i in range(900):
            # Starts on few days around month ends, so that days and day-of-month rules meet; some spells are equal.
            start = base + dt.timedelta(days=rng.choice([0, 6, 7, 35, 66, 67, 95, rng.randrange(2000)]))
            rows.append(("hot" if i % 3 == 0 else f"e{rng.randrange(60)}", i, start,
                         start + dt.timedelta(days=rng.choice([0, 30, 31, rng.randrange(1500)]))))
        df = spark.createDataFrame(rows, "id string, ix bigint, start_on date, end_on date").withColumn(
            "months", dates.whole_months(F.col("start_on"), F.col("end_on")))
        got = {(r["id"], r["ix"]): r["attributed"] for r in sp.attributed_months(df).collect()}
        assert got == brute_attribution(rows)
        both = sp.attributed_months(df, covered=True).groupBy("id").agg(F.count("months_covered").alias("n"), F.max("months_covered").alias("m"))
        union = {r["id"]: r["months_covered"] for r in sp.interval_union(df).collect()}
        assert {r["id"]: (r["n"], r["m"]) for r in both.collect()} == {k: (1, m) for k, m in union.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sp.attributed_months(df.limit(0)).count() == 0


def id_kinds(n):
    """Ids of several kinds, as text, with their SQL type: in sequence, random, UUIDs, with a long common prefix."""
    import uuid
    rng = random.Random(4)
    return {
        "sequence": ([i for i in range(n)], "bigint"),
        "random": ([rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)], "bigint"),
        "uuid": ([str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(n)], "string"),
        "prefix": ([f"candidate/{rng.getrandbits(40):012x}" for _ in range(n)], "string"),
    }


@pytest.mark.parametrize("kind", list(id_kinds(1)))
def test_ranked_equals_row_number_for_ids_of_any_kind(spark, kind):
    from pyspark.sql import Window
    ids, sql = id_kinds(3000)[kind]
    # A hot group without a score of its own: only the ids tell its rows apart.
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 5}", key, None if i % 7 == 0 else 0.5 if i % 3 else i % 40 / 4)
            for i, key in enumerate(ids)]
    df = spark.createDataFrame(rows, f"g string, id {sql}, s double")
    order = [F.desc("s"), F.col("id")]
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    for parts in (None, 30):
        got = skew.ranked(df, ["g"], order, parts=parts)
        assert got.columns == plain.columns and got.exceptAll(plain).count() == 0 and got.count() == len(rows)
    # No range, which is the most that is sorted in one task, holds much more than its share.
    placed = skew.in_ranges(df, [F.col("g"), *order], 30)
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 300


def test_ranges_of_equal_keys_fall_apart(spark):
    df = spark.range(4000).select(F.lit("a").alias("g"), F.lit(1).alias("k"))
    sizes = [r["count"] for r in skew.in_ranges(df, [F.col("g"), F.col("k")], 20).groupBy("_range").count().collect()]
    assert max(sizes) <= 600
    got = skew.ranked(df, ["g"], [F.col("k")], parts=20)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 4001))
    assert skew.ranked(df.limit(0), ["g"], [F.col("k")]).count() == 0


def test_selected_values_are_exact(spark):
    rng = random.Random(5)
    values = [rng.choice([0.0, -3.5, rng.gauss(0, 100), rng.random() / 1e6]) for _ in range(701)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["pick"]: r["v"] for r in skew.selected_values(df, "v", {
        "p50": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95)}).collect()}
    ordered = sorted(values)
    assert got == {"p50": ordered[350], "p95": ordered[int(701 * 0.95)]}


def test_carry_last_matches_window(spark):
    rng = random.Random(9)
    rows = [(i % 2, f"2024-01-01T{rng.randrange(24):02d}:{rng.randrange(60):02d}", i,
             rng.choice([None, "a", "b"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, at string, ord int, v string")
    got = skew.carry_last(df, ["k"], F.substring("at", 1, 13), ["at", "ord"],
                          F.col("v").isNotNull(), {"prev": F.col("v")})
    from pyspark.sql import Window
    window = Window.partitionBy("k").orderBy("at", "ord").rowsBetween(
        Window.unboundedPreceding, -1)
    plain = df.withColumn("prev", F.last("v", ignorenulls=True).over(window))
    assert got.exceptAll(plain).count() == 0 and got.count() == 300


def test_ndcg_by_hand(spark):
    rels = [3, 0, 2, 1]
    df = spark.createDataFrame([("q", i, r, i + 1) for i, r in enumerate(rels)],
                               "query string, item int, rel int, position int")
    import math
    dcg = sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(rels))
    ideal = sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(sorted(rels, reverse=True)))
    assert ev.ndcg(df, [10], ["query"]).first()["ndcg_10"] == pytest.approx(dcg / ideal)


def test_sign_flip_by_hand(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", -0.05), ("d", 0.117)],
                               "query string, delta double")
    row = ev.sign_flip(df, "delta").first()
    # 16 masks; only those flipping nothing, or -0.05 alone, reach the observed sum.
    assert (row["n_queries"], row["p_one_sided"], row["minimum_p"]) == (4, 0.125, 0.0625)


@pytest.mark.parametrize("heads", [3, 20, 64])
def test_resampled_deltas_against_whole_resamples(spark, heads):
    """Few heads leave places unfilled at first, so more are taken; small queries are read whole."""
    import hashlib
    import math
    rng = random.Random(heads)
    rows = []
    for query, n in (("big", 150), ("small", 6), ("one", 1)):
        a, b = rng.sample(range(1, n + 1), n), rng.sample(range(1, n + 1), n)
        rows += [(query, i, rng.choice([0, 0, 1, 2, 3]), a[i], b[i]) for i in range(n)]
    seed, resamples = 11, 12

    def dcg(rels):
        return sum((2 ** r - 1) / math.log2(p + 2) for p, r in enumerate(rels[:10]))

    want = []
    for draw in range(resamples):
        total = 0
        for query in ("big", "small", "one"):
            mine = [r for r in rows if r[0] == query]
            taken = [mine[int(hashlib.md5(f"{seed}|{draw}|{query}|{s}".encode()).hexdigest()[:7], 16) % len(mine)] for s in range(len(mine))]
            a, b, best = ([r[2] for r in sorted(taken, key=k)] for k in (lambda r: r[3], lambda r: r[4], lambda r: -r[2]))
            total += round((dcg(b) / dcg(best) - dcg(a) / dcg(best)) * 1e9) if dcg(best) else 0
        want.append(total / 3 / 1e9)
    df = spark.createDataFrame(rows, "query string, item int, rel int, pos_a int, pos_b int")
    got = {r["draw"]: r["delta"] for r in ev.bootstrap_deltas(df, resamples, [F.col("item")], seed, heads=heads).collect()}
    assert len(got) == resamples and all(abs(got[d] - w) < 2e-9 for d, w in enumerate(want))


def test_vocabularies_are_consistent():
    patterns = [p for items in vocab.TITLE_PATTERNS.values() for p in items]
    assert len(patterns) == len(set(patterns))
    assert not set(patterns) & set(vocab.AMBIGUOUS_TITLES)
    assert sum(fv.WEIGHTS.values()) == 100
    assert fv.MUST_POINTS + fv.GOOD_POINTS == fv.WEIGHTS["skill_overlap"]


def test_sign_flip_of_many_queries(spark):
    rng = random.Random(2)
    few = [round(rng.uniform(-0.3, 0.4), 4) for _ in range(12)]
    row = ev.sign_flip(spark.createDataFrame([(d,) for d in few], "delta double"), "delta").first()
    units = [round(d * 10_000) for d in few]
    sums = [sum(d if m >> i & 1 == 0 else -d for i, d in enumerate(units)) for m in range(1 << 12)]
    assert row["p_one_sided"] == round(sum(s >= sum(units) for s in sums) / len(sums), 4)
    many = spark.createDataFrame([(0.01,)] * 40, "delta double")
    assert tuple(ev.sign_flip(many, "delta").first()) == (40, 0.0, 0.0)
    assert tuple(ev.sign_flip(many.limit(0), "delta").first()) == (0, 1.0, 1.0)
    assert tuple(ev.sign_flip(spark.createDataFrame([(0.0,), (None,), (0.0,)], "delta double"), "delta").first()) == (2, 1.0, 0.25)
    assert tuple(ev.sign_flip(spark.createDataFrame([(0.5,)] * 5, "delta double"), "delta").first()) == (5, 0.0312, 0.0312)


@pytest.mark.parametrize("n,scale", [(3, 7), (60, 1000), (3000, 400)])
def test_sign_flip_equals_the_whole_distribution(spark, n, scale):
    rng = random.Random(n)
    deltas = [round(rng.gauss(0.5 / n, 0.3) * scale) for _ in range(n)]
    mass = np.ones(1)
    for size in sorted(map(abs, deltas)):
        wider = np.zeros(len(mass) + size)
        wider[:len(mass)] += mass / 2
        wider[size:] += mass / 2
        mass = wider
    want = mass[(sum(deltas) + sum(map(abs, deltas))) // 2:].sum()
    row = ev.sign_flip(spark.createDataFrame([(d / scale,) for d in deltas], "delta double"), "delta", scale).first()
    assert row["n_queries"] == n and abs(row["p_one_sided"] - want) < 5.1e-5
    assert 0.01 < want < 0.99


def test_folding_texts_at_once_equals_one_by_one():
    import unicodedata

    from matchloom.functions import text as tx

    def one(text):
        text = re.sub("[\u200b-\u200f\u2060\ufeff\ufe00-\ufe0f\U0001f3fb-\U0001f3ff\U0001f1e6-\U0001f1ff]", "", unicodedata.normalize("NFKC", text))
        text = "".join(ch for ch in text if unicodedata.category(ch) != "So")
        return " ".join(text.split()).casefold()

    rng = random.Random(8)
    pool = ["a", "Z", " ", "\t", "\n", "\x1c", "\x85", "\u3000", "\u0301", "\u0323", "e", "\ufb01", "\u2460", "\U0001f680", "\u200d",
            "\u1100", "\u1161", "\u11a8", "\xdf", "\u03c2", "\u0130", "\xa0", "\U0010ffff", "\ufdd0", "\x00", "\u212b", "\uff21", "\u2122"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(3000)] + [""]
    assert tx.fold_texts(texts) == [one(t) for t in texts]
    every = "".join(tx._DIVIDERS)
    assert tx.fold_texts([every + " A", " b "]) == [one(every + " A"), "b"] and tx.fold_texts([]) == []


def test_terms_in_a_word_of_any_length(spark):
    from matchloom.operators import scoring
    long = "ab" * 10_000 + "kafka" + "z" * 10_000
    entries = spark.createDataFrame([("p", 1, f"Built {long}"), ("q", 1, "kaf ka spark")], "id string, ix int, description string")
    terms = spark.createDataFrame([("kafka",), ("spark",), ("",), ("bz",), ("zz",)], "term string")
    got = {r.id: sorted(r.term_hits) for r in scoring.shipped_evidence(entries, terms).collect()}
    assert got == {"p": ["kafka", "zz"], "q": ["spark"]}


def test_decay_is_the_power_of_the_c_library(spark):
    ages = [r.d for r in spark.range(2500).select(dates.decay(F.col("id").cast("int")).alias("d")).orderBy("id").collect()]
    assert ages[:2400] == [math.pow(0.5, a / 36.0) for a in range(2400)]
    # 20 months of 53 ago at 0.9, and 9 months of 17 ago: equal on paper, one unit in the last place apart as doubles.
    assert 20.0 * ages[53] * 0.9 == 20.0 * math.pow(0.5, 53 / 36.0) * 0.9 < 9.0 * ages[17]
    assert all(ages[k] > ages[k + 1] > 0 for k in range(2399, 2499))


def test_pairs_of_a_few_files_are_dealt_out_and_scores_are_narrow(spark):
    from matchloom.operators import scoring
    from matchloom.plans import all_queries

    people = spark.range(200).select("id", F.array(F.lit("a")).alias("tags")).coalesce(1)
    jobs = spark.createDataFrame([(1, "x"), (2, "y")], "job_id int, city string")
    made = scoring.pairs(people, jobs)
    assert {(r.id, r.job_id, r.city) for r in made.collect()} == {(i, j, c) for i in range(200) for j, c in ((1, "x"), (2, "y"))}
    used = made.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= min(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert all_queries()
    from matchloom.plans import q_scoring
    assert set(q_scoring.scored(spark, "/root/testdata/sf0.001").columns) == {
        "id", "job_id", "score_breakdown", "missing_must_haves", "total", "fit_score", "confidence", "carried"}


def test_draws_are_dealt_out_over_tasks(spark):
    slots = spark.range(400).select(F.lit("q").alias("query"), F.col("id").alias("slot"), F.lit(400).alias("_n")).coalesce(1)
    draws = ev._draws(slots, 50, 1, "query")
    used = draws.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= min(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert draws.where("_no between 0 and 399").count() == 400 * 50
