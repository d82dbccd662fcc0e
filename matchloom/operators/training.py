"""The trained fallback classifier: hashed n-gram TF-IDF and a multinomial logistic regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import fixed_values as fv
from matchloom.functions.numeric import round_exact
from matchloom.operators.classify import RESULT
from matchloom.operators.skew import ranked
from matchloom.operators.values import per_value
from matchloom.session import materialised

# ---------------------------------------------------------------- fixed values
CHAR_GRAMS = [3, 4, 5]
INVERSE_REGULARISATION = 4.0
FOLDS = 5
# ------------------------------------------------------------ end fixed values
#: Blocks of features, each scaled to unit length, and the bits of a block's buckets.
BLOCKS = ["chars", "words"]
BITS = 13


def with_grams(df: DataFrame, core: str) -> DataFrame:
    """Adds words and padded character grams of a normalised title."""
    words = F.split(F.col(core), " ")
    # Words of one letter carry no weight of their own; pairs stand beside single words.
    kept = F.filter(words, lambda w: F.length(w) > 1)
    pairs = F.zip_with(F.slice(kept, F.lit(1), F.greatest(F.lit(0), F.size(kept) - 1)),
                       F.slice(kept, F.lit(2), F.greatest(F.lit(0), F.size(kept) - 1)),
                       lambda a, b: F.concat(a, F.lit(" "), b))

    def grams(n: int) -> Column:
        return F.flatten(F.transform(words, lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) + 3 - n)),
            lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(n)))))

    return df.withColumn("words", F.concat(kept, pairs)).withColumn("chars", F.concat(*[grams(n) for n in CHAR_GRAMS]))


def corpus_rows(df: DataFrame, core: str, label: str) -> DataFrame:
    """Distinct (title, label) rows with a balancing weight per class.

    Copies are folded before training, so the cost follows distinct titles.
    """
    rows = df.select(F.col(core).alias("core"), F.col(label).alias("label")).distinct()
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    whole = sizes.agg((F.sum("_n") / F.count(F.lit(1))).alias("w")).scalar()
    return rows.join(sizes, "label").withColumn("weight", whole / F.col("_n")).drop("_n")


def buckets(grams: Column, bits: int = BITS) -> Column:
    """A bucket of 2^bits for each gram, from its md5: the same in any SQL engine."""
    return F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 6), 16, 10).cast("int").bitwiseAND(
        F.lit((1 << bits) - 1)))


def with_buckets(df: DataFrame, core: str, bits: int = BITS) -> DataFrame:
    """Adds ``chars`` and ``words``: the buckets of a title's grams, repeats included."""
    return with_grams(df, core).withColumns({b: buckets(F.col(b), bits) for b in BLOCKS})


@dataclass
class Weights:
    """Inverse document frequencies per block and bucket: ln((1 + rows) / (1 + rows with it)) + 1."""
    bits: int
    idf: np.ndarray


def weigh(corpus: DataFrame, core: str, bits: int = BITS) -> Weights:
    """Weights from the rows of a corpus; what reaches the driver is bounded by the buckets."""
    rows = with_buckets(corpus.select(core), core, bits)
    found = rows.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), F.array_distinct(b).alias("own")) for k, b in enumerate(BLOCKS)])).alias("s")).select(
        "s.block", F.explode("s.own").alias("bucket")).groupBy("block", "bucket").agg(F.count(F.lit(1)).alias("n"))
    seen = np.zeros((len(BLOCKS), 1 << bits))
    for row in found.collect():
        seen[row.block, row.bucket] = row.n
    return Weights(bits, np.log((1 + corpus.count()) / (1 + seen)) + 1)


def sparse(columns: list[list[np.ndarray]], weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row: feature numbers in order and their values, each block of unit length.

    A count c weighs 1 + ln(c), times the weight of its bucket.
    """
    out = []
    for blocks in zip(*columns):
        at, values = [], []
        for k, own in enumerate(blocks):
            bucket, count = np.unique(own, return_counts=True)
            value = (1 + np.log(count)) * weights.idf[k][bucket]
            at.append(bucket + (k << weights.bits))
            values.append(value / np.sqrt((value * value).sum()) if len(value) else value)
        out.append((np.concatenate(at), np.concatenate(values)))
    return out


def _featured(df: DataFrame, core: str, weights: Weights, schema: T.StructType,
              column: Callable[[pa.Array, pa.Array], pa.Array]) -> DataFrame:
    rows = with_buckets(df.select(F.struct("*").alias("_row"), F.col(core).alias("_core")), "_core", weights.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sparse([[v.values.to_numpy() for v in batch.column(b)] for b in BLOCKS], weights)
            ends = pa.array(np.cumsum([0] + [len(a) for a, _ in found]), pa.int32())
            at, values = (np.concatenate([np.zeros(0), *x]) for x in zip(*found)) if found else (np.zeros(0),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("_row"), column(
                pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values)))],
                schema.names)

    return rows.select("_row", *BLOCKS).mapInArrow(run, schema)


def feature_rows(df: DataFrame, core: str, weights: Weights) -> DataFrame:
    """The columns of ``df`` with ``feature`` and ``value``: a row for each feature of each title."""
    kind = "array<struct<feature:int,value:double>>"
    schema = T.StructType([T.StructField("_row", df.select(F.struct("*").alias("r")).schema["r"].dataType)]).add(
        T.StructType.fromDDL(f"_f {kind}")[0])
    table = _featured(df, core, weights, schema, lambda at, values: pa.ListArray.from_arrays(
        at.offsets, pa.StructArray.from_arrays([at.values, values.values], ["feature", "value"])))
    return table.select("_row.*", F.explode("_f").alias("_f")).select(*df.columns, "_f.*")


def with_vectors(df: DataFrame, core: str, weights: Weights) -> DataFrame:
    """Adds ``features``, a sparse vector."""
    schema = T.StructType([T.StructField("_row", df.select(F.struct("*").alias("r")).schema["r"].dataType)]).add(
        "features", VectorUDT())
    width = len(BLOCKS) << weights.bits

    def vector(at: pa.Array, values: pa.Array) -> pa.Array:
        n = len(at)
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), at, values],
            ["type", "size", "indices", "values"])
    return _featured(df, core, weights, schema, vector).select("_row.*", "features")


@dataclass
class TitleModel:
    """Classes in alphabetical order, the weights of the features and the fitted regression."""
    classes: list[str]
    weights: Weights
    regression: LogisticRegressionModel


def train(corpus: DataFrame, bits: int = BITS) -> TitleModel:
    """Fit on (core, label, weight) rows.

    Grams are hashed, so no vocabulary is gathered: the driver and each task hold
    the weights of the buckets and the coefficients, bounded by buckets x classes.
    """
    weights = weigh(corpus, "core", bits)
    ready = with_vectors(corpus, "core", weights).cache()
    try:
        index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(ready)
        regression = LogisticRegression(
            family="multinomial", featuresCol="features", labelCol="y", weightCol="weight",
            regParam=1.0 / (INVERSE_REGULARISATION * max(ready.count(), 1)), standardization=False, maxIter=100)
        return TitleModel(list(index.labels), weights, regression.fit(index.transform(ready)))
    finally:
        ready.unpersist()


def coefficients(spark: SparkSession, model: TitleModel) -> DataFrame:
    """The model as a table: ``feature, label, weight``; the feature of an intercept is -1."""
    matrix, start = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    k, at = np.nonzero(matrix)
    rows = pa.table({"feature": np.concatenate([np.full(len(start), -1), at]).astype(np.int32),
                     "label": [model.classes[c] for c in [*range(len(start)), *k]],
                     "weight": np.concatenate([start, matrix[k, at]])})
    return spark.createDataFrame(rows)


def predict(df: DataFrame, core: str, model: TitleModel,
            minimum: float = fv.FALLBACK_MIN_PROBABILITY) -> DataFrame:
    """Adds the fallback result: best class, or null below ``minimum``; titles that repeat are read once each."""
    def read(rows: DataFrame) -> DataFrame:
        ready = model.regression.transform(with_vectors(rows, core, model.weights))
        probs = vector_to_array("probability")
        names = F.array(*[F.lit(c) for c in model.classes])
        ready = ready.withColumn("_p", probs).withColumn("_top", F.array_max("_p"))
        best = F.element_at(names, F.array_position("_p", F.col("_top")).cast("int"))
        sure = (F.col("_top") >= minimum) & (F.col(core) != "")
        out = F.when(sure, F.struct(
            best.alias("family"), round_exact(F.col("_top") * fv.FALLBACK_SCALE, 3).alias("confidence"),
            F.lit("distilled_lr").alias("source"),
            F.concat(F.lit("lr:p="), F.format_string("%.2f", "_top")).alias("evidence"))
        ).otherwise(F.lit(None).cast(RESULT))
        return ready.select(*rows.columns, best.alias("forced"), F.col("_top").alias("probability"),
                            out.alias("fallback"))

    return per_value(df, [core], read)


def folds(corpus: DataFrame, k: int = FOLDS, seed: int = fv.BOOTSTRAP_SEED) -> DataFrame:
    """Fold per row: the rank within its class by a digest of its content, modulo ``k``.

    So the folds of a class differ by at most one row.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "label", "core"))
    rows = corpus.withColumn("_digest", digest)
    placed = ranked(rows, ["label"], [F.col("_digest"), F.col("core")], "_place")
    return placed.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_digest", "_place")


def cross_validate(corpus: DataFrame, k: int = FOLDS) -> DataFrame:
    """Rows and correct forced predictions per fold; one fit per fold."""
    split = materialised(folds(corpus, k), "folds")
    parts = []
    for fold in range(k):
        fit_on, held = split.where(F.col("fold") != fold), split.where(F.col("fold") == fold)
        model = train(fit_on.drop("fold"))
        parts.append(predict(held, "core", model).groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col("forced") == F.col("label"), 1)).alias("correct")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
