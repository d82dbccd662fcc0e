"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of characters other than space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % modulus


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, chosen by a hash of ``key``: the same ones on each run.

    A hash threshold set from the row count thins the rows first, so the exact
    cut orders about ``rows`` rows at any input size.
    """
    total = df.count()
    cut = F.xxhash64(F.col(key), F.lit(17))
    if total > rows:
        share = min(1.0, 1.1 * rows / total + 100 / total)
        df = df.where(F.pmod(cut, F.lit(1 << 30)) < int(share * (1 << 30)))
    return df.orderBy(F.pmod(cut, F.lit(1 << 30)), F.col(key)).limit(rows)


def labelled(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """One row per learnable document: ``doc_id`` and ``y`` (0 or 1).

    Rows with a null id or label are left out, repeated ids count once (the
    larger label), and ids whose remainder is ``held`` are never learned from.
    """
    return (labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", modulus) != held))
            .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")))


def with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id``, ``y`` and ``text`` of the documents in ``wanted``, a bounded sample."""
    return docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")


def annotate(
    df: DataFrame, text: str, columns: list[tuple[str, str, pa.DataType]],
    make: Callable[[], Callable[[list], list[list]]], keep: bool = False,
) -> DataFrame:
    """Append columns computed from a text column, one Arrow batch at a time.

    ``make()`` runs once per task and returns a function from the batch's texts
    (str or None) to one list of values per column; ``columns`` gives each
    column's name, SQL type and Arrow type.  With ``keep`` the input row comes
    back whole as a struct ``row`` (so no column name can clash), else the input
    columns other than ``text`` stay.
    """
    if keep:
        df = df.select(F.struct("*").alias("row"), F.col(text).alias("_text"))
        text = "_text"
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in rest])
    for name, kind, _ in columns:
        schema = schema.add(T.StructType.fromDDL(f"{name} {kind}")[0])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            values = score(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in rest]
                + [pa.array(v, type=kind) for v, (_, _, kind) in zip(values, columns)], names)

    return df.select(*rest, text).mapInArrow(run, schema)


def rows_of(df: DataFrame) -> list:
    """Rows of a table whose size the caller has bounded (a model, a sample)."""
    return df.toPandas().to_dict("records")
