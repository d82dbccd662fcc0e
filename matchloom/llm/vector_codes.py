"""Product codes of vectors by Lloyd's algorithm on cover trees.

Vectors are cut into parts; each part position has a codebook.  The rows of a
partition stand in blocks, and each block has one cover tree per part: a node is
a range of the block's rows, with its first point as centre, the radius around
it, and children that lie farther from one another than the scale they cover.
Trees are built once and written as a table.

A round walks every tree from its root.  By the triangle inequality an entry
farther from a centre than the nearest one by more than twice the radius can be
nearest to no point below; where one entry is left, the whole subtree goes to it
through cumulative sums.  Only leaves that stay ambiguous compare their points.
Tasks return sums per entry, so what meets after a round has the size of the
codebooks.  All comparisons that decide use integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.session import materialised

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of a block; its points and trees are one row of the table.
BLOCK = 8192
#: Rows below which a node is a leaf, and the ratio of the scales of two levels.
LEAF = 24
BASE = 1.7
#: Components of this magnitude or more (times ``SCALE``) would overflow squared distances.
LIMIT = 1 << 28


@dataclass
class CoverTree:
    """Nodes in breadth-first order over ``order``, a permutation of the points."""
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray

    def pack(self) -> bytes:
        head = np.array([len(self.order), len(self.start)], np.int64).tobytes()
        ints = [self.order, self.start, self.end, self.first, self.children]
        return head + b"".join(a.astype("<i4").tobytes() for a in ints) + self.radius.astype("<f8").tobytes()

    @staticmethod
    def unpack(data: bytes) -> CoverTree:
        points, nodes = np.frombuffer(data, "<i8", 2)
        at, out = 16, []
        for size in (points, nodes, nodes, nodes, nodes):
            out.append(np.frombuffer(data, "<i4", size, at))
            at += 4 * int(size)
        order, start, end, first, children = out
        return CoverTree(order, start, end, np.frombuffer(data, "<f8", nodes, at), first, children)


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = points - centre
    return np.einsum("ij,ij->i", apart, apart)


def grow(points: np.ndarray) -> CoverTree:
    """The cover tree of integer points; equal points end in one leaf of radius 0."""
    order = np.arange(len(points))
    away = np.sqrt(distances(points, points[0]))
    start, end, radius, first, children = [0], [len(points)], [away.max()], [-1], [0]
    level = [(0, away)]
    while level:
        below = []
        for node, away in level:
            low, high = start[node], end[node]
            if high - low <= LEAF or radius[node] == 0:
                continue
            scale = radius[node] / BASE
            own = order[low:high]
            left = np.arange(high - low)
            groups = []
            # The node's own centre first; then points that no child covers yet become centres.
            while len(left):
                if groups:
                    away = np.sqrt(distances(points[own[left]], points[own[left[0]]]))
                near = away <= scale
                groups.append((left[near], away[near]))
                left, away = left[~near], away[~near]
            order[low:high] = own[np.concatenate([g for g, _ in groups])]
            first[node], children[node] = len(start), len(groups)
            at = low
            for group, away in groups:
                below.append((len(start), away))
                start.append(at)
                at += len(group)
                end.append(at)
                radius.append(away.max())
                first.append(-1)
                children.append(0)
        level = below
    # Square roots may be a hair too small.
    return CoverTree(order, *(np.array(a) for a in (start, end)), np.array(radius) * (1 + 1e-12),
                     *(np.array(a) for a in (first, children)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - np.concatenate([[0], ends[:-1]]), sizes) + np.arange(ends[-1] if len(ends) else 0)


def assign(tree: CoverTree, points: np.ndarray, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of ``tree.order`` and the entry nearest to all their points: (starts, ends, entries).

    ``points`` stand in the tree's order.  Ties go to the lower entry.
    """
    nodes = np.zeros(1, np.int64)
    open_ = np.ones((1, len(book)), bool)
    while len(nodes):
        low, high, radius = tree.start[nodes], tree.end[nodes], tree.radius[nodes]
        square = _squares(points[low], book)
        exact = np.where(open_, square, np.iinfo(np.int64).max)
        nearest = exact.argmin(axis=1)
        away = np.where(open_, np.sqrt(square), np.inf)
        best = away[np.arange(len(nodes)), nearest]
        slack = 1e-9 * (best + radius) + 1e-9
        open_ = open_ & (away <= (best + 2 * radius + slack)[:, None])
        settled = (radius == 0) | (open_.sum(axis=1) == 1)
        if settled.any():
            yield low[settled], high[settled], nearest[settled]
        leaf = ~settled & (tree.children[nodes] == 0)
        if leaf.any():
            at = ranges(low[leaf], high[leaf] - low[leaf])
            yield at, at + 1, _squares(points[at], book).argmin(axis=1)
        inner = ~settled & ~leaf
        count = tree.children[nodes[inner]]
        open_ = np.repeat(open_[inner], count, axis=0)
        nodes = ranges(tree.first[nodes[inner]], count)


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``row`` (the other columns) and ``v``, the integer components, of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LIMIT / SCALE))
    rest = [c for c in vectors.columns if c != vector]
    rows = vectors.where(v.isNotNull() & finite & (F.size(v) > 0)).select(
        F.struct(*rest).alias("row"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    # A row per length that occurs, not per vector.
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _wide(flat: np.ndarray, rows: int) -> np.ndarray:
    """The vectors as (part, row, component), zeros at the end if the length is no multiple of ``PARTS``."""
    whole = flat.reshape(rows, -1)
    missing = -whole.shape[1] % PARTS
    if missing:
        whole = np.concatenate([whole, np.zeros((rows, missing), np.int64)], axis=1)
    return whole.reshape(rows, PARTS, -1).transpose(1, 0, 2)


def trees(rows: DataFrame) -> DataFrame:
    """Blocks of rows: ``rows``, their points of every part in tree order, and the trees."""
    kind = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType))]).add(
        "points", T.ArrayType(T.BinaryType())).add("trees", T.ArrayType(T.BinaryType()))

    def block(part: pa.Table) -> pa.RecordBatch:
        own = part.column("row").combine_chunks()
        values = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        points, grown = [], []
        for x in _wide(values, len(own)):
            tree = grow(x)
            points.append(x[tree.order].astype("<i4").tobytes())
            grown.append(tree.pack())
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
            pa.array([points], pa.list_(pa.binary())), pa.array([grown], pa.list_(pa.binary()))], kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held)
                while len(table) >= BLOCK:
                    yield block(table.slice(0, BLOCK))
                    table = table.slice(BLOCK)
                held = table.to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, kind)


def first_books(rows: DataFrame, id_col: str, entries: int) -> np.ndarray:
    """(part, entry, component): the vectors with the smallest ids, at most ``entries`` of them."""
    least = rows.orderBy(F.col(f"row.{id_col}").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not least:
        return np.zeros((PARTS, 0, 0), np.int64)
    return _wide(np.array([r.v for r in least], np.int64).ravel(), len(least)).copy()


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, CoverTree]]:
    """(row of the batch, part, points in tree order, tree) of every block."""
    for k in range(batch.num_rows):
        points, grown = (batch.column(c)[k].as_py() for c in ("points", "trees"))
        for p in range(PARTS):
            tree = CoverTree.unpack(grown[p])
            yield k, p, np.frombuffer(points[p], "<i4").astype(np.int64).reshape(len(tree.order), -1), tree


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per entry: a count, then the sum of each component.
        sums = np.zeros((parts, entries, 1 + width), np.int64)
        for batch in batches:
            for _, p, points, tree in _parts(batch):
                running = np.zeros((len(points) + 1, 1 + width), np.int64)
                running[1:, 0] = np.arange(1, len(points) + 1)
                np.cumsum(points, axis=0, out=running[1:, 1:])
                for low, high, entry in assign(tree, points, books[p]):
                    np.add.at(sums[p], entry, running[high] - running[low])
        at = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums.ravel()[at])], ["at", "sum"])

    met = blocks.select("points", "trees").mapInArrow(run, "at long, sum long").groupBy("at").agg(F.sum("sum").alias("sum"))
    sums = np.zeros(parts * entries * (1 + width), np.int64)
    for row in met.collect():  # at most one row per component of the codebooks
        sums[row.at] = row.sum
    sums = sums.reshape(parts, entries, 1 + width)
    count = sums[:, :, :1]
    return np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``row``, ``codes`` (an entry per part) and ``error``, the squared distance over all parts."""
    kind = T.StructType([T.StructField("row", blocks.schema["rows"].dataType.elementType)]).add(
        "codes", T.ArrayType(T.IntegerType())).add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in enumerate(batch.column("rows")):
                n = len(own)
                codes, error = np.zeros((n, PARTS), np.int32), np.zeros(n, np.int64)
                for _, p, points, tree in _parts(batch.slice(k, 1)):
                    found = np.zeros(n, np.int32)
                    for low, high, entry in assign(tree, points, books[p]):
                        found[ranges(low, high - low)] = np.repeat(entry, high - low)
                    codes[tree.order, p] = found
                    error[tree.order] += distances(points, books[p][found])
                flat = pa.array(codes.ravel())
                yield pa.RecordBatch.from_arrays([
                    own.values, pa.ListArray.from_arrays(pa.array(range(0, PARTS * n + 1, PARTS), pa.int32()), flat),
                    pa.array(error)], kind.names)

    return blocks.mapInArrow(run, kind)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``row`` (all columns but the vector), ``codes`` and ``error`` per vector, and the codebooks.

    Left out are vectors that are null or empty, hold null or non-finite components
    or such of 65,536 and more (whose squared distances have no 64-bit value), or
    have another length than most (the shorter one of equally common lengths).
    Where the length is no multiple of ``PARTS``, zeros follow.  Rows with equal ids
    each get a row; null ids stand last.  With fewer rows than entries the codebooks
    have an entry per row.  An empty table gives no rows and empty codebooks.
    """
    rows = integers(vectors, vector)
    books = first_books(rows, id_col, entries)
    if not books.size:
        empty = rows.select("row", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
        return empty.where(F.lit(False)), books
    blocks = materialised(trees(rows), "cover-trees")
    for _ in range(rounds):
        books = improved(blocks, books)
    return coded(blocks, books), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(table: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_error``: the errors of all rows with an equal label, nulls together.

    A label may hold most rows, so sums are combined before their shuffle and come
    back by a join, which splits a hot label.
    """
    sums = materialised(table.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return table.join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def _oracle() -> str:
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
  FROM kept, (SELECT unnest(range({PARTS})) AS p)),
book0 AS MATERIALIZED (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))"""]
    near = """
near{t} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := d, e := e)) AS m FROM (
    SELECT r, parts.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN book{t} b ON parts.p = b.p) GROUP BY r, p)"""
    for t in range(ROUNDS):
        steps.append(near.format(t=t))
        steps.append(f"""
sums{t} AS MATERIALIZED (
  SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM (
    SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
      SELECT n.p, n.m.e AS e, unnest(parts.x) AS x, generate_subscripts(parts.x, 1) AS i
      FROM near{t} n JOIN parts ON n.r = parts.r AND n.p = parts.p) GROUP BY p, e, i) GROUP BY p, e),
book{t + 1} AS MATERIALIZED (
  SELECT b.p, b.e, COALESCE(s.c, b.c) AS c FROM book{t} b LEFT JOIN sums{t} s ON b.p = s.p AND b.e = s.e)""")
    steps.append(near.format(t=ROUNDS))
    steps.append(f"""
codes AS (
  SELECT r, string_agg(printf('%02x', m.e::INTEGER), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error
  FROM near{ROUNDS} GROUP BY r),
digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM book{ROUNDS}))""")
    return "WITH" + ",".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), digest"""


ORACLE = _oracle()
