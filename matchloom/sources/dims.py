"""Dictionary tables: loading and the checks that must hold before they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import text as tx


def load_dictionary(spark: SparkSession, path: str, value: str, member: str) -> DataFrame:
    """(value, member, ordinal) rows of a JSON object of name to list."""
    doc = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string, array<string>>")
    rows = doc.select(F.posexplode(F.map_entries(pairs)).alias("_i", "_e"))
    return rows.select("_i", F.col("_e.key").alias(value),
                       F.posexplode("_e.value").alias("_j", "_m")).select(
        value, tx.norm_text(F.col("_m")).alias(member),
        (F.col("_i").cast("bigint") * F.lit(1 << 20) + F.col("_j")).alias("ordinal"))


def conflicts(dim: DataFrame, member: str, value: str) -> DataFrame:
    """Members listed under more than one value."""
    return dim.groupBy(member).agg(
        F.count_distinct(value).alias("n_values"), F.min(value).alias("first_value"),
        F.max(value).alias("last_value")).where("n_values > 1")


def overlaps(a: DataFrame, b: DataFrame, member: str) -> DataFrame:
    return a.select(member).distinct().join(b.select(member).distinct(), member)


def one_sided(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose mirror image is not listed; empty for a symmetric table."""
    mirrored = pairs.select(F.col(b).alias(a), F.col(a).alias(b))
    return pairs.select(a, b).distinct().join(mirrored, [a, b], "left_anti")


def first_wins(dim: DataFrame, member: str, value: str, ordinal: str) -> DataFrame:
    return dim.groupBy(member).agg(F.min_by(value, ordinal).alias(value))


def unknown_values(dim: DataFrame, value: str, allowed: list[str] | None = None) -> DataFrame:
    allowed = fv.FAMILIES if allowed is None else allowed
    return dim.where(~F.col(value).isin(allowed)).select(value).distinct()


def sums_to(weights: DataFrame, weight: str, target: float) -> DataFrame:
    """Empty when the weights sum to ``target``; else the sum that was found."""
    return weights.agg(F.sum(weight).alias("found")).where(F.abs(F.col("found") - target) > 1e-6)


def refuse_rows(df: DataFrame, what: str) -> None:
    """Raise when a check returned any row; at most three are shown."""
    bad = df.limit(3).collect()
    if bad:
        raise ValueError(f"{what}: {[row.asDict() for row in bad]}")
