"""Phrase search against one regular expression per term."""

import random
import time

import regex

from matchloom.functions import phrases as ph
from matchloom.functions import text as tx
from matchloom.operators import scoring as sc
from pyspark.sql import functions as F


def slow(text, terms, whole_words=True):
    edge = (r"(?<!\w)", r"(?!\w)") if whole_words else ("", "")
    return [i for i, t in enumerate(terms) if t and terms.index(t) == i and regex.search(edge[0] + regex.escape(t) + edge[1], text)]


def samples():
    rng = random.Random(3)
    signs = ["c++", "ci/cd", "node.js", ".net", "a", "ab", "b a", "é", "naïve", "x́", "漢", "漢字", "#1", "data", "data eng", "a b a", "_", "1", ""]
    terms = signs + ["data", "a"]
    texts = ["", "data engineer", "C++ c++ c++x", "ab a", "xab", "naïve-naïves", "漢字 漢", "ci/cd_", "x́y x́", "a‍b", "data eng.", "_a_ a_b"]
    texts += ["".join(rng.choices(["a", "b", " ", "é", "_", "1", "́", "data", "c++", ".", "漢"], k=rng.randint(1, 25))) for _ in range(400)]
    return texts, terms


def test_found_terms_equal_a_search_for_each(spark):
    texts, terms = samples()
    for whole in (True, False):
        for text in texts:
            assert ph.find(text, ph.automaton(tuple(terms)), whole) == slow(text, terms, whole), (text, whole)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.h for r in df.select("i", ph.hits(F.col("t"), terms).alias("h")).collect()}
    assert got == {i: slow(t, terms) for i, t in enumerate(texts)} | {-1: []}
    assert [r.h for r in df.limit(2).select(ph.hits(F.col("t"), [""]).alias("h")).collect()] == [[], []]


def test_boundaries_equal_the_expression_form(spark):
    texts, terms = samples()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in ("c++", "a", "é", "data", "漢"):
        rows = df.select(tx.has_phrase(F.col("t"), term).alias("want"), ph.hits(F.col("t"), [term]).alias("got")).collect()
        assert [bool(r.got) for r in rows] == [r.want for r in rows], term


def test_cost_does_not_follow_the_number_of_terms():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    texts = [" ".join(word() for _ in range(60)) for _ in range(300)]
    few = tuple(texts[0].split()[:50])
    many = few + tuple({f"{word()} {word()}" for _ in range(25_000)} | {word() for _ in range(25_000)})

    def seconds(terms):
        made = ph.automaton(terms)
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            found = [ph.find(t, made) for t in texts]
            best = min(best, time.perf_counter() - start)
        return best, found

    short, found = seconds(few)
    long, more = seconds(many)
    assert found[0] == list(range(50)) and more[0][:50] == found[0]
    # A search of each of 50,000 terms would take a thousand times as long.
    assert long < 10 * short + 0.05


def test_terms_of_jobs_held_or_joined(spark, monkeypatch):
    entries = spark.createDataFrame([
        (1, 1, "Built postgresql and kafka"), (1, 2, "Led kubernetes-on-call"), (2, 1, None), (3, 1, ""), (4, 1, "sqlsql SQL kaf")],
        "id int, ix int, description string")
    terms = spark.createDataFrame([("sql",), ("kafka",), ("kube",), ("spark",), ("sql",), ("",)], "term string")
    want = {1: ["kafka", "kube", "sql"], 2: [], 3: [], 4: ["sql"]}
    for limit in (100, 1):
        monkeypatch.setattr(sc, "HELD_TERMS", limit)
        got = {r.id: sorted(r.term_hits) for r in sc.shipped_evidence(entries, terms).collect()}
        assert got == want
