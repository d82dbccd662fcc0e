"""Cover-tree product codes against plain Lloyd rounds."""

import math

import numpy as np
import pytest

pytest.importorskip("matchloom.llm.queries")

from matchloom.llm import vector_codes as vc  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, row string, codes int, error string"
SF = "/root/testdata/sf0.001"


def brute(rows, entries=16, rounds=6):
    """(id, label, code, error) of every row that takes part, and the codebooks."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) and abs(x) < 65536 for x in v)]
    sizes = [len(v) for _, v, _ in kept]
    if not kept:
        return [], []
    common = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    kept = [(i, v + [0] * (-len(v) % 8), label) for i, v, label in kept if len(v) == common]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // 8
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for p in range(8):
        x = [v[p * width:(p + 1) * width] for _, v, _ in kept]
        book = [v[p * width:(p + 1) * width] for _, v, _ in first]

        def nearest(y, book):
            return min((sum((a - b) ** 2 for a, b in zip(y, c)), e) for e, c in enumerate(book))
        for _ in range(rounds):
            own = [nearest(y, book)[1] for y in x]
            for e in range(len(book)):
                mine = [y for y, o in zip(x, own) if o == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        for k, y in enumerate(x):
            d, e = nearest(y, book)
            codes[k].append(e)
            errors[k] += d
        books.append(book)
    return [(i, label, c, d) for (i, _, label), c, d in zip(kept, codes, errors)], books


def check(spark, rows, **named):
    table = spark.createDataFrame([(i, v, label, "clash", 1, "clash") for i, v, label in rows], VECTORS).repartition(3)
    got, books = vc.compress(table, **named)
    want, want_books = brute(rows, **named)
    assert sorted(map(str, ((r.row.vec_id, r.row.label, r.codes, r.error) for r in got.collect()))) == sorted(map(str, want))
    assert books.tolist() == want_books
    assert set(got.schema["row"].dataType.names) == {"vec_id", "label", "row", "codes", "error"}
    return got, want


@pytest.mark.parametrize("block", [64, 8192])
def test_codes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.3, (12, 16))
    rows = [(int(i), (centres[i % 12] + rng.normal(0, 0.02, 16)).astype(np.float32).tolist(), int(i % 5)) for i in range(500)]
    nan, inf = float("nan"), float("inf")
    rows += [(600, None, 1), (601, [], 1), (602, [nan] + [0.0] * 15, 1), (603, [0.0] * 15 + [-inf], 1), (604, [None] + [0.0] * 15, 2),
             (605, [1e20] * 16, 1), (606, [0.5] * 15, 1), (7, rows[7][1], 2), (None, [0.25] * 16, None), (None, [0.25] * 16, None)]
    rows += [(700 + k, [0.125] * 16, 4) for k in range(150)]
    got, want = check(spark, rows)
    table = got.select("row.label", "error")
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert {(r.label, r.label_error) for r in vc.with_label_errors(table).collect()} == set(sums.items())


def test_ties_few_rows_and_odd_lengths(spark):
    # A grid of few values: many equal distances; entries that nothing is nearest to.
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) / 4096 for x in rng.integers(-2, 3, 8)], None) for i in range(300)]
    check(spark, rows)
    check(spark, [(i, [float(i), 1.0, -2.5], 0) for i in range(5)], entries=16, rounds=3)
    check(spark, [(1, [0.5] * 8, 0)] * 40)
    empty, books = vc.compress(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and books.size == 0
    assert vc.compress(spark.createDataFrame([(1, None, 1, "", 0, "")], VECTORS))[0].count() == 0


def test_trees_cover_their_points_and_save_comparisons():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (16, 4))
    points = np.floor(4096 * (centres[rng.integers(0, 16, 6000)] + rng.normal(0, 0.01, (6000, 4)))).astype(np.int64)
    points[100:400] = points[0]
    tree = vc.CoverTree.unpack(vc.grow(points).pack())
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    x = points[tree.order]
    for n in range(len(tree.start)):
        own = x[tree.start[n]:tree.end[n]]
        assert (np.sqrt(vc.distances(own, own[0])) <= tree.radius[n]).all()
        kids = range(tree.first[n], tree.first[n] + tree.children[n])
        if kids:
            assert tree.start[kids[0]] == tree.start[n] and tree.end[kids[-1]] == tree.end[n]
            centres = x[tree.start[list(kids)]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1)) + np.eye(len(kids)) * 1e9
            assert (apart > tree.radius[n] / vc.BASE * (1 - 1e-9)).all()
    book = np.floor(4096 * centres).astype(np.int64)
    owner, compared = np.full(len(points), -1), 0
    for low, high, entry in vc.assign(tree, x, book):
        compared += len(low)
        owner[vc.ranges(low, high - low)] = np.repeat(entry, high - low)
    assert (owner == ((x[:, None] - book[None]) ** 2).sum(-1).argmin(1)).all()
    assert compared < len(points) / 10
