"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight; the
documents of a source in order of their keys are a weighted sample without
replacement.  A source's target is filled with complete epochs first, then with
the documents of smallest keys up to the words that are left; the document at
the edge gives the words that still fit.

A source may hold most rows, so none is sorted whole: keys fall into ``BUCKETS``
ranges, range sizes are summed before the shuffle, and only the range in which
the budget ends is ordered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import annotate
from matchloom.session import materialised

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this multiple of all words.
SHARE = 1.5
#: No source, and no document, is taken more often than this.
REPEATS = 2
BUCKETS = 4096
SEED = "mix-1"


_SIGNS = b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def measure(text: str | None) -> tuple[int, float]:
    """Number of words, and a quality weight from 0.05 to 1.

    The weight falls with the share of digits and signs among the characters;
    null and empty texts have no words and the least weight.
    """
    if not text:
        return 0, 0.05
    data = text.encode()
    signs = len(data) - len(data.translate(None, _SIGNS))
    return len(data.split()), max(0.05, 1 - 4.0 * signs / len(text))


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from the md5 of a key and the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("|" + SEED))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 12))


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source with its ``source_size``.

    Filling by weight with a cap per source: sources in order of cap over weight
    are capped while their fair share of what is left would exceed the cap.
    ``sizes`` has a row per source, so its windows order names, not documents.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(named) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    cap = F.col("source_size") * float(REPEATS)
    ranked = sizes.withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(WEIGHTS))))).withColumn(
        "place", place).withColumn("cap", cap)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(after))
    # The level is right at the first source that it does not fill; later ones share it.
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = level.withColumn("order", F.row_number().over(filling)).withColumn("open", open_)
    level = level.withColumn("final", F.min_by("open", F.when(F.col("open").isNotNull(), F.col("order"))).over(every))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key``: the text's size and its exponential key."""
    measured = annotate(docs.select("doc_id", "source", "text"), "text", [
        ("size", "long", pa.int64()), ("quality", "double", pa.float64())],
        lambda: lambda texts: [list(c) for c in zip(*map(measure, texts))] or [[], []])
    key = -F.log(uniform(F.col("doc_id"))) / F.col("quality")
    return measured.select("doc_id", "source", "size", key.alias("key"))


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every document.

    Rows with equal ids have equal keys and are ordered by size; equal rows are
    interchangeable.  Null and empty texts take nothing.  An empty table gives no rows.
    """
    bucket = F.floor(F.lit(BUCKETS) * (1 - F.exp(-F.col("key")))).cast("int")
    # Texts are read once; sizes and keys are written, for several passes follow.
    rows = materialised(keyed(docs).withColumn("bucket", bucket), "mix-keys")
    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size"))
    sizes = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    aims = targets(sizes).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)))
    same = cells["source"].eqNullSafe(aims["source"])
    # Few rows: at most BUCKETS for each source.
    plan = cells.join(aims, same).select(
        cells["source"], "bucket", "cell_size", "before", "source_size", "target", "epochs", "budget")
    whole = F.col("before") + F.col("cell_size") <= F.col("budget")
    plan = plan.withColumn("state", F.when(whole, 1).when(F.col("before") >= F.col("budget"), 0).otherwise(2)).drop("cell_size")
    placed = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))
                                  & (F.col("r.bucket") == F.col("p.bucket"))).select("r.*", "before", "source_size", "target",
                                                                                     "epochs", "budget", "state")
    edge = placed.where("state = 2")
    upto = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = edge.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before")))
    settled = placed.where("state <> 2").withColumn("part", F.when(F.col("state") == 1, F.col("size")).otherwise(0).cast("long"))
    both = settled.unionByName(inside.withColumn("part", part.cast("long")))
    return both.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN length(text) > 0
              THEN greatest(0.05, 1 - 4.0::DOUBLE * len(regexp_extract_all(text, '[0-9!-/:-@\\[-`{{-~]')) / length(text))
              ELSE 0.05 END AS quality,
         (('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null') || '|{SEED}'), 1, 12))::BIGINT::DOUBLE + 0.5)
           / {float(16 ** 12)} AS u
  FROM documents),
keyed AS (SELECT doc_id, source, size, -ln(u) / quality AS key FROM docs),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place,
                  {REPEATS}.0::DOUBLE * source_size AS cap FROM sizes),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM ranked),
-- The level L at which capped shares add up: the largest that leaves every earlier source full.
levels AS (
  SELECT a.place, a.cap / a.weight AS ratio,
         ((SELECT sum(source_size) FROM weighed) * {SHARE}::DOUBLE
           - COALESCE(sum(b.cap) FILTER (WHERE (b.cap / b.weight, b.place) < (a.cap / a.weight, a.place)), 0))
         / sum(b.weight) FILTER (WHERE (b.cap / b.weight, b.place) >= (a.cap / a.weight, a.place)) AS level
  FROM weighed a, weighed b GROUP BY a.place, a.cap, a.weight),
final AS (SELECT arg_min(level, (ratio, place)) AS level FROM levels WHERE level <= ratio),
aims AS (
  SELECT source, source_size, CASE WHEN final.level IS NULL THEN cap ELSE least(cap, final.level * weight) END AS target
  FROM weighed, final),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM aims),
placed AS (
  SELECT k.*, b.source_size, b.target, b.epochs, round(b.target - b.epochs * b.source_size)::BIGINT AS budget,
         COALESCE(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken
FROM placed
"""
