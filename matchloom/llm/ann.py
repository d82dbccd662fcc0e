"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample; every vector is then routed to one leaf per
tree.  A query walks all trees through one priority queue, nearest margins
first, until the leaves it has taken hold enough vectors.  Vectors and queries
meet leaf by leaf, candidates are ranked by their exact inner products, and the
best of each leaf are merged.

Equal vectors are indexed once, with the ids that can matter; a leaf with many
vectors is split into blocks, each of which all its queries visit, and the
queries of a leaf with many of them are dealt out over copies of its blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import bounded_sample
from matchloom.session import materialised

#: Trees of the forest, and levels of each: 2^DEPTH leaves.
TREES = 32
DEPTH = 7
#: At most this many vectors, chosen by a hash of the id, are used to grow the trees.
SAMPLE = 50_000
#: A query takes leaves until they hold this share of all vectors, counted with repeats over the trees.
SHARE = 0.75
#: Vectors of a leaf that are compared in one task at a time.
BLOCK = 4096
#: Queries of a leaf that are asked in one task, about, and of those that are scored at a time.
ASKED = 4096
SLICE = 256
SEED = 5


def usable(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, vec`` of the rows that take part, each once.

    Left out are rows without an id, null, empty or zero vectors, vectors with a null, NaN or
    infinite component, and those of another length than most vectors have.
    """
    vec = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = table.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n").collect()
    return rows.where(F.size("vec") == (common[0]["n"] if common else 0)).distinct()


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix; all its lists have one length."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


class Forest:
    """Trees as complete binary heaps: a normal and a threshold for each inner node.

    Inner products become angles to compare by giving each vector one more
    component that brings all to the length of the longest; queries have zero there.
    """

    def __init__(self, sample: np.ndarray, longest: float, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        self.depth, self.longest = depth, longest
        rng = np.random.default_rng(seed)
        rows = self.lift(sample)
        nodes = (1 << depth) - 1
        self.normal = np.zeros((trees, nodes, rows.shape[1] if len(rows) else 1), np.float32)
        self.cut = np.zeros((trees, nodes), np.float32)
        for tree in range(trees):
            members = {0: np.arange(len(rows))}
            for node in range(nodes):
                here = members.pop(node, np.zeros(0, np.int64))
                if len(here) >= 2:
                    a, b = rows[rng.choice(here, 2, replace=False)]
                    way = a - b
                    size = np.linalg.norm(way)
                    way = way / size if size else rng.normal(size=rows.shape[1])
                    at = rows[here] @ way
                    cut = np.median(at)
                    self.normal[tree, node], self.cut[tree, node] = way, cut
                    right = at > cut
                    members[2 * node + 1], members[2 * node + 2] = here[~right], here[right]

    def lift(self, rows: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(0.0, self.longest ** 2 - (rows ** 2).sum(axis=1)))
        return np.column_stack([rows, more]).astype(np.float32)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        lifted = self.lift(rows)
        out = np.zeros((len(rows), len(self.cut)), np.int32)
        for tree in range(len(self.cut)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                side = np.einsum("nd,nd->n", lifted, self.normal[tree, node]) > self.cut[tree, node]
                node = 2 * node + 1 + side
            out[:, tree] = node - ((1 << self.depth) - 1)
        return out

    def visit(self, query: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, until they hold ``enough`` vectors."""
        lifted = np.append(query, 0.0).astype(np.float32)
        margins = (self.normal @ lifted - self.cut).tolist()
        inner = (1 << self.depth) - 1
        queue = [(float("-inf"), tree, 0) for tree in range(len(margins))]
        heapq.heapify(queue)
        taken, held = [], 0
        while queue and held < enough:
            worst, tree, node = heapq.heappop(queue)
            if node >= inner:
                leaf = node - inner
                if sizes[tree, leaf]:
                    taken.append((tree, leaf))
                    held += int(sizes[tree, leaf])
                continue
            margin = margins[tree][node]
            # How far the query is on the wrong side of the worst cut on the way; the right side costs nothing.
            heapq.heappush(queue, (max(worst, -margin), tree, 2 * node + 2))
            heapq.heappush(queue, (max(worst, margin), tree, 2 * node + 1))
        return taken


def search(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20,
           trees: int = TREES, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found for each row whose id ``every`` divides.

    Scores are inner products in double precision; ties go to the smaller id.
    Candidates are all usable rows but those with the query's id.
    """
    spark = table.sparkSession
    rows = materialised(usable(table, id_col, vector), "vectors")
    # Of equal vectors, only the k + 1 smallest ids can be among the k nearest.
    first = Window.partitionBy("vec").orderBy("id")
    near = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    reps = materialised(near.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), F.monotonically_increasing_id().alias("key"), "vec", "ids"), "distinct-vectors")
    facts = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        "vec", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    sample = bounded_sample(reps.select("key", "vec"), "key", SAMPLE).toPandas()
    forest = spark.sparkContext.broadcast(Forest(np.stack(sample["vec"]), float(np.sqrt(facts["square"])), trees, depth))
    leaves = 1 << depth

    def count(batches):
        total = np.zeros((trees, leaves), np.int64)
        for batch in batches:
            if batch.num_rows:
                for tree, leaf in enumerate(forest.value.leaves(_matrix(batch.column("vec"))).T):
                    total[tree] += np.bincount(leaf, minlength=leaves)
        tree, leaf = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(leaf.astype(np.int32)),
                                          pa.array(total[tree, leaf])], ["tree", "leaf", "n"])

    counted = reps.select("vec").mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(
        F.sum("n").alias("n")).toPandas()
    table_sizes = np.zeros((trees, leaves), np.int64)
    table_sizes[counted["tree"], counted["leaf"]] = counted["n"]
    sizes = spark.sparkContext.broadcast(table_sizes)
    enough = max(int(share * facts["n"]), 4 * (k + 1) * trees)
    cell = "tree int, leaf int, block int, salt int"

    def plan(batches):
        for batch in batches:
            cells = [[tree * leaves + leaf for tree, leaf in forest.value.visit(query, sizes.value, enough)]
                     for query in (_matrix(batch.column("vec")) if batch.num_rows else [])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(cells, pa.list_(pa.int32()))], ["id", "vec", "cells"])

    visits = materialised(rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).mapInArrow(
        plan, "id long, vec array<double>, cells array<int>"), "visits")
    asked_of = np.zeros(trees * leaves, np.int64)
    # One row for each leaf of each tree at most.
    for row in visits.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        asked_of[row["cell"]] = row["count"]
    salts = spark.sparkContext.broadcast(np.maximum(1, -(-asked_of // ASKED)).reshape(trees, leaves))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, reps = batch.column("key").to_numpy(), batch.column("rep").to_numpy()
            where = forest.value.leaves(_matrix(batch.column("vec")))
            tree = np.tile(np.arange(trees, dtype=np.int32), len(keys))
            leaf = where.reshape(-1)
            parts = -(-sizes.value[tree, leaf] // BLOCK)
            at = np.repeat(np.arange(len(keys)), trees)
            block = ((keys[at] * 0x9E3779B1 >> 16) % parts).astype(np.int32)
            copies = salts.value[tree, leaf]
            for salt in range(copies.max()):
                here = np.flatnonzero(copies > salt)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree[here]), pa.array(leaf[here]), pa.array(block[here]), pa.array(np.full(len(here), salt, np.int32)),
                     pa.array(keys[at[here]]), pa.array(reps[at[here]]), batch.column("vec").take(pa.array(at[here]))],
                    ["tree", "leaf", "block", "salt", "key", "rep", "vec"])

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            # An id may have several vectors, so the place in the batch takes part in the salt.
            mixed = (batch.column("id").to_numpy() * 0x9E3779B1 >> 16) + np.arange(batch.num_rows)
            for i, cells in enumerate(batch.column("cells").to_pylist()):
                for tree, leaf in (divmod(c, leaves) for c in cells):
                    salt = int(mixed[i] % salts.value[tree, leaf])
                    out += [(tree, leaf, b, salt, i) for b in range(-(-int(sizes.value[tree, leaf]) // BLOCK))]
            tree, leaf, block, salt, at = (np.array(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c.astype(np.int32)) for c in (tree, leaf, block, salt)),
                 batch.column("id").take(pa.array(at)), batch.column("vec").take(pa.array(at))],
                ["tree", "leaf", "block", "salt", "query_id", "query"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        # Ties go to the smaller id, as in the end.
        left = left.sort_by([("rep", "ascending"), ("key", "ascending")])
        keys = left.column("key").to_numpy()
        ids = right.column("query_id").to_numpy()
        found = []
        if len(keys) and len(ids):
            queries, vectors = _matrix(right.column("query").combine_chunks()), _matrix(left.column("vec").combine_chunks())
            parts = []
            for start in range(0, len(ids), SLICE):
                # einsum sums every pair in the same order, whatever stands beside it.
                scores = np.einsum("qd,nd->qn", queries[start:start + SLICE], vectors)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k + 1]
                parts.append((np.repeat(ids[start:start + SLICE], best.shape[1]), keys[best].reshape(-1),
                              np.take_along_axis(scores, best, axis=1).reshape(-1)))
            found = [np.concatenate(c) for c in zip(*parts)]
        found = found or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": found[0], "key": found[1], "score": found[2]})

    placed = reps.select("key", "rep", "vec").mapInArrow(place, cell + ", key long, rep long, vec array<double>")
    asked = visits.mapInArrow(ask, cell + ", query_id long, query array<double>")
    at_cell = ["tree", "leaf", "block", "salt"]
    pairs = placed.groupBy(*at_cell).cogroup(asked.groupBy(*at_cell)).applyInArrow(
        compare, "query_id long, key long, score double")
    # A vector found through several trees has the same score each time.
    best = pairs.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    kept = best.join(reps.select("key", "rep"), "key").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    ranked = kept.join(reps.select("key", "ids"), "key").select(
        "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # An id that has several vectors is a candidate once, with its best.
    ranked = ranked.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return ranked.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
