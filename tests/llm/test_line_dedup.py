"""Line removal against counting in Python, and the filters on their own."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("matchloom.llm.queries")

from matchloom.llm import line_dedup as ld  # noqa: E402

DOCS = "doc_id long, text string, row string, id long, keys string"
SPACE = " \t\n\v\f\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, length=40, documents=5):
    def key(line):
        return line.strip(SPACE).translate(UPPER)

    holders = {}
    for k, (_, text) in enumerate(rows):
        for line in {key(x) for x in (text or "").split("\n")}:
            if len(line) >= length:
                holders.setdefault(line, set()).add(k)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(key(line), set())
            ids = [rows[k][0] for k in held if rows[k][0] is not None]
            if not (len(held) >= documents and ids and i != max(ids)):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, None) for i, t in rows], DOCS)


def edge_rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeXYZäß漢", k=8))
    shared = [" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        lines = [rng.choice(shared) for _ in range(rng.randint(0, 12))] + [" ".join(word() for _ in range(6)) for _ in range(3)]
        lines = [rng.choice(["", " ", "\t\r"]) + (x.translate(UPPER) if rng.random() < 0.3 else x) + rng.choice(["", "\x0b ", "\r"]) for x in lines]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    exact = "ä" * 40
    rows += [(None, None), (200, None), (201, ""), (202, "\n\n"), (203, shared[0] + "\n" + shared[0])]
    rows += [(300 + k, exact) for k in range(5)] + [(310 + k, "ä" * 39 + " ") for k in range(5)] + [(320 + k, "b" * 41) for k in range(4)]
    rows += [(None, "only in rows without an id, and in many of them")] * 6 + [(None, exact), (304, exact), (304, exact + "\nmore")]
    rows += [(400, "a very long line " * 100_000), (401, "short\n" * 200_000 + shared[0])]
    return rows


@pytest.mark.parametrize("bits", [None, 1 << 18])
def test_lines_against_brute_force(spark, bits):
    rows = edge_rows()
    got = ld.drop_repeated(table(spark, rows), bits=bits).select("row.doc_id", "n_lines", "n_dropped", "kept", "row.row").collect()
    assert {r.row for r in got} == {"clash"}
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, brute(rows)))
    assert sum(r.n_dropped for r in got) > 300


def test_empty_table_and_parameters(spark):
    assert ld.drop_repeated(table(spark, [])).count() == 0
    rows = [(1, "one two\nx"), (2, "One Two \ny"), (3, "three")]
    got = ld.drop_repeated(table(spark, rows), length=5, documents=2).select("row.doc_id", "n_lines", "n_dropped", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 5, 2))


def test_second_filter_has_every_repeat_and_few_others(spark):
    rng = np.random.default_rng(1)
    keys = [rng.bytes(16) for _ in range(60_000)]
    twice = set(keys[:500])
    rows = [(k, 0, b"".join(sorted(keys[10 * k:10 * k + 10]))) for k in range(6_000)] + [
        (10_000 + k, 0, key) for k, key in enumerate(keys[:500])]
    docs = spark.createDataFrame(rows, "id long, mark long, keys binary").repartition(40)
    for parts_bits in (None, 1 << 18):
        found = [bytes(r.key) for r in ld.suspects(docs, parts_bits).collect()]
        assert all(found.count(k) == 2 for k in twice)
        assert len(found) - 1000 < 0.02 * len(keys)


def test_filter_adds_what_it_has():
    rng = np.random.default_rng(2)
    low, high = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    f = ld.Filter(1 << 17)
    places = f.places(low, high)
    f.add(places[:, :2500])
    assert f.has(places[:, :2500]).all() and f.has(places[:, 2500:]).mean() < 0.05
    assert np.unpackbits(f.data).sum() == len(np.unique(places[:, :2500]))
    ld.Filter(1 << 10).add(places[:, :0])
    assert ld.key_of(b"x" * 39) is None and ld.key_of("é".encode() * 39) is None and ld.key_of("é".encode() * 40)
    assert ld.halves(pa.array([], pa.binary()))[0].size == 0
