"""Removal of lines that many documents share, with two Bloom filters.

A first filter holds the keys seen once, a second one those seen twice.  Each
task fills its own pair over the documents it reads; a merge of two pairs puts
into the second filter what either had there and what both had seen once.  A key
of two documents is therefore always in the second filter, so only keys found in
it, the suspected repeats, go through a shuffle, where their documents are
counted exactly and the one document that keeps its lines is chosen.

Keys stand for their lines as 128 bits of a cryptographic digest.  The filters
are sized from the number of keys.  Beyond ``BITS`` the keys are dealt into
ranges of their digest, each with its own pair of filters, so a filter works as
well at any size and what is broadcast stays bounded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.session import materialised

#: White space that a key loses at both ends.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Code points that a key has at least, and documents that hold it.
LENGTH = 40
DOCUMENTS = 5
#: Bits of one filter: 32 MB, the bound on what is broadcast at a time.
BITS = 1 << 28
BITS_PER_KEY = 12
HASHES = 4
#: Bits of the piece of a filter that is merged as one row, and tasks whose pieces meet first.
SEGMENT = 1 << 20
FAN = 64


def key_of(line: bytes, length: int = LENGTH) -> bytes | None:
    """The digest of a line's key; None if the key has fewer than ``length`` code points."""
    key = line.strip(SPACE)
    if len(key) < length or not key.isascii() and len(key.decode()) < length:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def document_keys(docs: DataFrame, id_col: str, text: str, length: int = LENGTH) -> DataFrame:
    """``id, mark, keys``: the distinct keys of each document, joined; documents without any are left out.

    ``mark`` is a hash of the text, which tells rows with equal ids apart.
    """
    table = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("_text"))
    schema = T.StructType([table.schema["id"], table.schema["mark"]]).add("keys", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for value in batch.column("_text").cast(pa.binary()):
                found = {key_of(line, length) for line in (value.as_py() or b"").split(b"\n")}
                found.discard(None)
                keys.append(b"".join(sorted(found)) or None)
            out = pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(keys, pa.binary())], schema.names)
            yield out.filter(out.column("keys").is_valid())

    return table.mapInArrow(run, schema)


def halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of every key of a column of joined keys."""
    words = np.frombuffer(b"".join(column.to_pylist()), "<u8")
    return words[::2], words[1::2]


class Filter:
    """A Bloom filter of a power of two of bits."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.mask = np.uint64(bits - 1)
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        steps = np.arange(HASHES, dtype=np.uint64)[:, None]
        return (low + steps * (high | np.uint64(1))) & self.mask

    def has(self, places: np.ndarray) -> np.ndarray:
        bits = self.data[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)
        return (bits & 1).all(axis=0)

    def add(self, places: np.ndarray) -> None:
        places = np.unique(places)
        if not len(places):
            return
        at = places >> np.uint64(3)
        first = np.flatnonzero(np.diff(at, prepend=at[0] + np.uint64(1)))
        bits = np.left_shift(1, places & np.uint64(7), dtype=np.uint64).astype(np.uint8)
        self.data[at[first]] |= np.bitwise_or.reduceat(bits, first)


def in_range(low: np.ndarray, part: int, parts: int) -> np.ndarray:
    return (low >> np.uint64(40)) % np.uint64(parts) == part


def local_filters(keys: DataFrame, bits: int, part: int, parts: int) -> DataFrame:
    """Segments of each task's two filters: ``segment, fan, once, twice``, compressed."""
    size = min(SEGMENT, bits) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(bits), Filter(bits)
        for batch in batches:
            low, high = halves(batch.column("keys"))
            if parts > 1:
                mine = in_range(low, part, parts)
                low, high = low[mine], high[mine]
            # Equal keys of one batch: all but the first have been seen before.
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            again = np.zeros(len(low), bool)
            again[1:] = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
            places = once.places(low, high)
            twice.add(places[:, again | once.has(places)])
            once.add(places)
        fan = TaskContext.get().partitionId() % FAN
        for k in range(bits // 8 // size):
            piece = once.data[k * size:(k + 1) * size]
            if piece.any():
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([k], pa.int32()), "fan": pa.array([fan], pa.int32()),
                    "once": [zlib.compress(piece.tobytes(), 1)],
                    "twice": [zlib.compress(twice.data[k * size:(k + 1) * size].tobytes(), 1)]})

    return keys.select("keys").mapInArrow(run, "segment int, fan int, once binary, twice binary")


def merged(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Segments with equal ``by`` as one, compressed."""
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        once = twice = None
        for one, two in zip(group.column("once"), group.column("twice")):
            one, two = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (one, two))
            once, twice = (one, two) if once is None else (once | one, twice | two | (once & one))
        return pa.table({**{c: pa.array([k.as_py()], pa.int32()) for c, k in zip(by, key)},
                         "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    schema = "".join(f"{c} int, " for c in by) + "once binary, twice binary"
    return pieces.groupBy(*by).applyInArrow(merge, schema)


def seen_twice(keys: DataFrame, bits: int, part: int = 0, parts: int = 1) -> bytes:
    """The second filter over all documents; ``bits`` bound its size."""
    # A task's filters weigh the same for few keys as for many, so few tasks fill them.
    tasks = keys.sparkSession.sparkContext.defaultParallelism
    pieces = merged(local_filters(keys.coalesce(tasks), bits, part, parts), ["segment", "fan"])
    rows = merged(pieces, ["segment"]).select("segment", "twice").toLocalIterator()
    size = min(SEGMENT, bits) // 8
    data = bytearray(bits // 8)
    for row in rows:
        data[row.segment * size:(row.segment + 1) * size] = zlib.decompress(row.twice)
    return bytes(data)


def suspects(keys: DataFrame, bits: int | None = None) -> DataFrame:
    """``id, mark, key`` of every key that the second filter holds: all that two documents share, and few others."""
    spark = keys.sparkSession
    total = keys.agg(F.sum(F.length("keys"))).first()[0] or 0
    wanted = max(SEGMENT, BITS_PER_KEY * total // 16)
    bits = bits or BITS
    parts = -(-wanted // bits)
    bits = min(bits, 1 << (wanted - 1).bit_length())
    schema = T.StructType([keys.schema["id"], keys.schema["mark"]]).add("key", "binary")
    found = None
    for part in range(parts):
        data = spark.sparkContext.broadcast(seen_twice(keys, bits, part, parts))

        def run(batches: Iterator[pa.RecordBatch], part=part, data=data) -> Iterator[pa.RecordBatch]:
            twice = Filter(bits, data.value)
            for batch in batches:
                joined = batch.column("keys")
                low, high = halves(joined)
                hit = twice.has(twice.places(low, high)) & in_range(low, part, parts)
                owner = np.repeat(np.arange(batch.num_rows), [len(k) // 16 for k in joined.to_pylist()])[hit]
                both = np.stack([low[hit], high[hit]], axis=1).astype("<u8").tobytes()
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("mark").take(rows),
                     pa.array([both[k:k + 16] for k in range(0, len(both), 16)], pa.binary())], schema.names)

        one = materialised(keys.mapInArrow(run, schema), "suspects")
        data.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def repeated(suspected: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """``key, keeper``: keys of at least that many documents, and the largest id that holds each."""
    return (suspected.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
            .where(F.col("docs") >= documents).select("key", "keeper"))


def drops(keys: DataFrame, documents: int = DOCUMENTS, bits: int | None = None) -> DataFrame:
    """``id, mark, drop``: the joined keys that each document loses."""
    suspected = suspects(keys, bits)
    confirmed = materialised(repeated(suspected, documents), "repeated")
    # A hot key is split by the adaptive skew join: the confirmed side has one row for it.
    lost = suspected.join(confirmed, "key").where(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")))
    # Distinct keys of one text: bounded by that text.
    return materialised(lost.groupBy("id", "mark").agg(F.collect_set("key").alias("drop")), "drops")


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
                  documents: int = DOCUMENTS, bits: int | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_lines``, ``n_dropped`` and ``kept``, the text without dropped lines.

    Every row is a document: rows with equal ids count one by one, and keep a line
    together where theirs is the largest id.  A row without an id is never the
    keeper, unless no document with the line has an id; then all keep it.  Null
    and empty texts are one empty line, kept as an empty text.  Lines that a
    document holds several times go or stay together.  An empty table gives no rows.
    """
    keys = materialised(document_keys(docs, id_col, text, length), "line-keys")
    lost = drops(keys, documents, bits)
    table = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_mark"))
    met = table.join(lost, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_mark") == F.col("mark")), "left").select(
        "row", F.col(f"row.{text}").alias("_text"), "drop")
    schema = T.StructType([met.schema["row"]]).add("n_lines", "long").add("n_dropped", "long").add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, kept = [], [], []
            for value, drop in zip(batch.column("_text").cast(pa.binary()), batch.column("drop")):
                data, drop = value.as_py() or b"", drop.as_py()
                lines.append(data.count(b"\n") + 1)
                if drop:
                    gone = set(drop)
                    left = [x for x in data.split(b"\n") if key_of(x, length) not in gone]
                    dropped.append(lines[-1] - len(left))
                    data = b"\n".join(left)
                else:
                    dropped.append(0)
                kept.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    return met.mapInArrow(run, schema)


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
many AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {LENGTH}
  GROUP BY key HAVING count(DISTINCT r) >= {DOCUMENTS}),
marked AS (
  SELECT k.*, m.key IS NOT NULL AND m.keeper IS NOT NULL AND k.doc_id IS DISTINCT FROM m.keeper AS gone
  FROM keyed k LEFT JOIN many m ON k.key = m.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
