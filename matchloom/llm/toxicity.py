"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from labelled documents: whole words and word beginnings
that toxic documents use far more often than others do, in different surroundings.  The features are
densities of its entries, how near they stand to words of the second person,
rates of capitals, punctuation and obfuscation, and length.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import annotate, bounded_sample, labelled, with_text
from matchloom.session import materialised

#: At most this many labelled documents are learned from, chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: The lexicon keeps at most this many entries, the strongest first.
LEXICON = 3000
#: Entries looked at more closely while it is learned.
CANDIDATES = 20_000
#: Least log-likelihood gain of an entry: chance alone reaches it about once in 10^5 entries.
GAIN = 12.0
#: Lengths of word beginnings that can become entries; whole words carry a mark at the end.
BEGINNINGS = (4, 5, 6, 7)
END = "$"
NEAR = 5
# Words of the second person in the languages at hand, and signs that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros su sus".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»“”„…–—"
NAMES = ["lex_density", "lex_hits", "lex_kinds", "lex_weight", "lex_near_second", "second_rate", "capitals",
         "capital_words", "punctuation", "exclamations", "obfuscated", "obfuscated_hits", "length"]
INNER = re.compile(r"[^\W_]+", re.UNICODE)


def plain(token: str) -> tuple[str, bool]:
    """The token without its outer signs and in letters only, and whether that undid an obfuscation."""
    core = token.strip(PUNCTUATION)
    if core.isalpha() or not core:
        return core, False
    undone = "".join(c for c in core.translate(LEET) if c.isalpha())
    letters = sum(c.isalpha() for c in core)
    # Numbers, addresses and two words around a sign are no obfuscation.
    return undone, 2 * letters >= len(core) > 0 and letters > 1 and len(core) <= 24


def entries(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) >= n] + [word + END]


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries and their weights (log odds) from ``text`` and ``y`` of a bounded sample."""
    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words = {plain(t)[0] for t in set((text or "").lower().split())}
                for entry in {e for w in words if len(w) > 2 for e in entries(w)}:
                    total[entry, y] += 1
        names = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.int32()),
             pa.array([total[n] for n in names], pa.int64())], ["entry", "y", "n"])

    sizes = {int(r["y"]): r["count"] for r in sample.groupBy("y").count().toPandas().to_dict("records")}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return {}
    counted = sample.mapInArrow(count, "entry string, y int, n long").groupBy("entry").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    share = pos / (pos + neg)
    # Gain in log-likelihood of the entry's own share of toxic documents over the general one.
    own = F.col("p") / (F.col("p") + F.col("q"))
    gain = F.col("p") * F.log(own / share) + F.when(F.col("q") > 0, F.col("q") * F.log((1 - own) / (1 - share))).otherwise(0)
    weight = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1))

    def strongest(rows: DataFrame, most: int) -> DataFrame:
        return (rows.where((own > share) & (F.col("p") > 0)).withColumn("gain", gain).withColumn("w", weight)
                .where((F.col("gain") >= GAIN) & (F.col("w") >= 1.5))
                .orderBy(F.desc("gain"), "entry").limit(most))

    candidates = frozenset(strongest(counted, CANDIDATES).select("entry").toPandas()["entry"])
    # Copies of one toxic text would make all its words look toxic, so an entry's evidence is
    # the number of different surroundings (word before, word after) in which it stands.
    seen = sample.mapInArrow(_surroundings(candidates), "entry string, y int, around long").distinct()
    apart = seen.groupBy("entry").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    strong = strongest(apart, LEXICON).select("entry", "w").toPandas()
    return dict(zip(strong["entry"], strong["w"].astype(float)))


def _surroundings(candidates: frozenset):
    starts = frozenset(e[:4] for e in candidates)

    def run(batches):
        for batch in batches:
            found = set()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                tokens = (text or "").lower().split()
                for i, token in enumerate(tokens):
                    word = token if token.isalpha() else plain(token)[0]
                    if word[:4] in starts or word + END in candidates:
                        before = tokens[i - 1] if i else ""
                        after = tokens[i + 1] if i + 1 < len(tokens) else ""
                        around = xxhash.xxh64_intdigest(f"{before}\n{after}") >> 1
                        found.update((e, y, around) for e in entries(word) if e in candidates)
            rows = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.int64())], ["entry", "y", "around"])

    return run


def features(text: str | None, lexicon: dict[str, float], starts: frozenset) -> list[float]:
    """The dense features of a whole text, in the order of ``NAMES``."""
    text = text or ""
    raw = text.split()
    hits = kinds = 0
    weight = 0.0
    veiled = veiled_hits = second = near = capital_words = 0
    seen = set()
    places = []
    persons = []
    for i, token in enumerate(text.lower().split()):
        if not token.isalpha():
            word, undone = plain(token)
            veiled += undone
        else:
            word, undone = token, False
        if word in SECOND_PERSON:
            persons.append(i)
        if word[:4] in starts or (len(word) < 4 and word + END in lexicon):
            found = [lexicon[e] for e in entries(word) if e in lexicon]
            if found:
                hits += 1
                weight += max(found)
                veiled_hits += undone
                seen.add(word[:4])
                places.append(i)
    second, kinds = len(persons), len(seen)
    if places and persons:
        at = set(persons)
        near = sum(any(p + d in at for d in range(-NEAR, NEAR + 1)) for p in places)
    n = max(1, len(raw))
    for token in raw:
        if token.isupper():
            capital_words += len(token) > 2
    data = text.encode("utf-8", "replace")
    size = max(1, len(data))
    capitals = size - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    signs = size - len(data.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    return [hits / n, math.log1p(hits), float(kinds), weight / n, near / max(1, hits), second / n, capitals / size,
            capital_words / n, signs / size, data.count(b"!") / size, veiled / n, math.log1p(veiled_hits), math.log1p(n)]


def featurise(docs: DataFrame, lexicon: dict[str, float], text: str = "text", keep: bool = False) -> DataFrame:
    """Adds one double column per feature; the lexicon has at most ``LEXICON`` entries."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        entries_ = shared.value
        starts = frozenset(e[:4] for e in entries_)

        def score(texts):
            return [list(c) for c in zip(*(features(t, entries_, starts) for t in texts))] or [[] for _ in NAMES]
        return score

    return annotate(docs, text, [(f"f_{n}", "double", pa.float64()) for n in NAMES], make, keep)


class Model:
    """A lexicon, boosted trees and the calibration; ``prior`` stands in where there is one class only."""

    def __init__(self, lexicon, trees, calibration, prior):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def score(self, docs: DataFrame, keep: bool = False) -> DataFrame:
        """Adds ``toxic_score`` (0 to 1); null and empty texts are scored from their features too."""
        rows = featurise(docs, self.lexicon, keep=keep)
        columns = [f"f_{n}" for n in NAMES]
        rest = [c for c in rows.columns if c not in columns]
        if self.trees is None:
            return rows.select(*rest, F.lit(self.prior).alias("toxic_score"))
        return _margin(self.calibration, _trees(self.trees, rows.select(
            F.struct(*rest).alias("_in"), *columns))).select("_in.*", "toxic_score")


def _trees(trees, rows: DataFrame) -> DataFrame:
    vector = VectorAssembler(inputCols=[f"f_{n}" for n in NAMES], outputCol="_vector")
    return trees.transform(vector.transform(rows)).withColumn("_margin", vector_to_array("rawPrediction")[1])


def _margin(calibration, rows: DataFrame) -> DataFrame:
    out = calibration.transform(rows)
    return out.withColumn("toxic_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_calibrated"))))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled documents whose remainder is not ``held``.

    A quarter of them, by another hash, calibrates and is not seen by the trees.
    """
    wanted = bounded_sample(labelled(labels, "toxic", modulus, held), "doc_id", rows)
    sample = materialised(with_text(docs, wanted), "toxic-sample")
    sizes = {int(r["y"]): r["count"] for r in sample.groupBy("y").count().toPandas().to_dict("records")}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return Model({}, None, None, prior)
    lexicon = learn_lexicon(sample)
    rows_ = materialised(featurise(sample, lexicon), "toxic-features").withColumn("_y", F.col("y").cast("double"))
    vector = VectorAssembler(inputCols=[f"f_{n}" for n in NAMES], outputCol="_vector").transform(rows_)
    apart = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    fit, check = vector.where(~apart), vector.where(apart)
    if fit.select("_y").distinct().count() < 2 or check.select("_y").distinct().count() < 2:
        fit = check = vector
    trees = GBTClassifier(featuresCol="_vector", labelCol="_y", maxIter=16, maxDepth=3, stepSize=0.3, seed=11).fit(fit)
    margins = trees.transform(check).withColumn("_margin", vector_to_array("rawPrediction")[1])
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="_y", predictionCol="_calibrated").fit(
        margins.select("_margin", "_y"))
    return Model(lexicon, trees, calibration, prior)


def filter_stage(docs: DataFrame, labels: DataFrame, most: float = 0.7) -> DataFrame:
    """Drops documents with a score of ``most`` or more."""
    return train(docs, labels).score(docs, keep=True).where(F.col("toxic_score") < most).select("row.*")
