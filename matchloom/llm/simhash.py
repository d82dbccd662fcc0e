"""Near-duplicate detection with SimHash fingerprints and multi-index hashing.

Fingerprints are cut into segments.  For a distance of 2 over two segments,
either the first segment differs in at most one bit or the second in none, so
each fingerprint looks up a Hamming ball of radius 1 in the first segment's
table and its own value in the second's; every match is verified on all 64 bits.

A segment table bucket with more than ``CROWDED`` fingerprints (a large group of
near copies) would yield the square of its size in pairs.  The fingerprints that
touch such a bucket take an exact way without pairs: two fingerprints differ in
at most two bits if and only if their radius-1 balls share a value, so all that
meet at a value are tied to the smallest of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialised

DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Buckets above this many distinct fingerprints are linked through shared ball values.
CROWDED = 32
#: Shingles hashed at a time, so that a very long text needs no more memory.
PIECE = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, PIECE):
        part = words[start:start + PIECE + shingle - 1]
        tuples = zip(*(part[k:] for k in range(shingle)))
        hashes = np.array([digest(join(t), seed) for t in tuples], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # uint8 sums of at most 255 rows are exact and much faster than wide ones.
        for row in range(0, len(bits), 255):
            ones += bits[row:row + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All other columns of ``docs`` and ``fp``, the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in rest] + [pa.array(fps)], rest + ["fp"])

    return docs.select(*rest, text).mapInArrow(run, schema)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(fp: Column) -> list[tuple[Column, list[int]]]:
    """Each segment's value, and the bit masks of the ball to look up in its table."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    return [(low, [0] + [1 << b for b in range(32)]), (high, [0])]


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, that tie all fingerprints within ``DISTANCE`` of one another.

    ``distinct`` holds each fingerprint once as ``fp``.  Two fingerprints are
    connected through the result if and only if they are connected through pairs
    at that distance.
    """
    segments = _segments(F.col("fp"))
    table = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("seg"), value.alias("key"))
        for i, (value, _) in enumerate(segments)])).alias("e")).select("fp", "e.seg", "e.key")
    def ball_of(i: int, value: Column, masks: list[int]) -> Column:
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]),
                           lambda m: F.struct(F.lit(i).alias("seg"), value.bitwiseXOR(m).alias("key")))

    probes = distinct.select("fp", F.explode(F.concat(*[
        ball_of(i, value, masks) for i, (value, masks) in enumerate(segments)])).alias("e")).select("fp", "e.seg", "e.key")
    counts = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.where(F.col("n") > CROWDED).select("seg", "key")
    # A bucket that only its own fingerprint could fetch needs no entry; others are compared.
    roomy = table.join(crowded, ["seg", "key"], "left_anti").withColumnRenamed("fp", "other")
    verified = (
        probes.join(roomy, ["seg", "key"])
        .where((F.col("fp") > F.col("other"))
               & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE))
        .select(F.col("fp").alias("u"), F.col("other").alias("v")))
    touched = probes.join(crowded, ["seg", "key"], "left_semi").select("fp").distinct()
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1).cast("long") if b == 0 else
                                            F.lit(-(1 << 63) if b == 63 else 1 << b).cast("long")
                                            for b in range(64)])
    # At most 65 fingerprints have a given value in their ball, so the lists are bounded.
    met = (touched.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
           .groupBy("at").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    tied = met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u > v")
    return verified.unionByName(tied).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node connected with each node that has an edge.

    Alternates large-star and small-star steps.  Minima are aggregates and
    joins, so no neighbourhood is gathered; each step is written out, which cuts
    the lineage and survives lost executors.
    """
    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialised(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialised(small, "edges")
        after = signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def labelled(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``groups`` and ``label``, which tells groups apart that have the same smallest id."""
    marked = materialised(fingerprints(docs.select(id_col, text), text), "fingerprints")
    distinct = materialised(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    labels = components(links(distinct.select("fp")))
    named = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = named.select("fp", "label").join(smallest, "label").select("fp", "component_id", "label")
    return marked.join(by_fp, "fp").select(id_col, "fp", "component_id", "label")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``fp`` and ``component_id``, the smallest id reachable.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with equal ids each get a row; a null id belongs to its group but is
    never its smallest id, unless all ids of the group are null.
    """
    return labelled(docs, id_col, text).drop("label")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents with one of each group left: a row with the smallest id.

    Where several rows of the group share that id, one of them stays; rows of
    other groups are not touched by it.  A row without an id stands behind all
    others of its group, so it stays only if none has an id.
    """
    behind = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    key = F.coalesce(F.col("doc_id").cast("long"), behind)
    marked = labelled(docs.select(key.alias("_key"), "text"), "_key")
    kept = marked.where("_key = component_id").groupBy("_key", "label", "fp").agg(F.count(F.lit(1)).alias("_rows"))
    # A group whose smallest id has several fingerprints keeps one of them.
    kept = materialised(kept.groupBy("_key", "label").agg(F.min(F.struct("fp", "_rows")).alias("_one")).select(
        "_key", "_one.*"), "kept")
    # The rows that stay grow with the documents, so both sides are dealt out at every size.
    rows = fingerprints(docs.select(key.alias("_key"), F.struct("*").alias("_row"), "text")).join(
        kept.hint("merge"), ["_key", "fp"])
    # Only an id and fingerprint that several rows share need a shuffle of those rows.
    once = rows.where("_rows = 1").select("_row.*")
    again = rows.where("_rows > 1").dropDuplicates(["_key", "fp"]).select("_row.*")
    return once.unionByName(again)
