"""Language identification by multilingual mixture inference.

Each language has a distribution over character trigrams inside words.  A
document is a mixture: every word comes from one language, and its likelihood
under a language is the product over its trigrams.  Expectation-maximisation
estimates the document's language proportions; the set of languages is the one
with the best penalised likelihood among the sets of its k largest proportions.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import annotate, remainder

#: Trigrams are counted in this many cells (2 to the power).
CELL_BITS = 18
#: At most about this many training documents per language, chosen by a hash of the id.
TRAIN_PER_LANGUAGE = 2000
#: Pseudo-count of every known trigram in every language.
SMOOTHING = 0.5
#: Characters looked at together; a longer text is cut into pieces of this size.
PIECE = 1 << 19
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigram cells of all words of a text, and where each word begins in them."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    # Two spaces before and one after, so that every word has its boundary trigrams.
    padded = np.full(len(code) + 3, 32, np.uint32)
    padded[2:-1][letter] = code[letter]
    third, second, first = padded[2:], padded[1:-1].copy(), padded[:-2].copy()
    first[second == 32] = 32
    at = np.flatnonzero((third != 32) | (second != 32))
    mixed = (first[at] * np.uint32(0x9E3779B1)) ^ (second[at] * np.uint32(0x85EBCA77)) ^ (third[at] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    starts = np.flatnonzero(second[at] == 32)
    return (mixed >> np.uint32(32 - CELL_BITS)).astype(np.int64), starts


def train(docs: DataFrame, modulus: int = 5, held: int = 0) -> dict:
    """``{"names": [...], "log": cells x languages}`` from a bounded sample per language.

    Uses only documents with a language whose id's remainder is not ``held``;
    rows without an id are never learned from.  The model has 2^18 cells per language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & (remainder("doc_id", modulus) != held)).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().toPandas().to_dict("records")}
    names = sorted(sizes)
    if not names:
        return {"names": [], "log": np.zeros((1 << CELL_BITS, 0), np.float32)}
    scale = 1 << 20
    cut = F.lit(0)
    for name in names:
        share = min(1.0, TRAIN_PER_LANGUAGE / sizes[name])
        cut = F.when(F.col("lang") == name, math.ceil(share * scale)).otherwise(cut)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(scale)) < cut).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                have = total.setdefault(lang, np.zeros(1 << CELL_BITS, np.int64))
                for start in range(0, len(text), PIECE):
                    np.add.at(have, cells(text[start:start + PIECE])[0], 1)
        for lang, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(have[at])], ["lang", "cell", "n"])

    counts = chosen.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(
        F.sum("n").alias("n")).toPandas()
    table = np.zeros((1 << CELL_BITS, len(names)), np.float64)
    where = {name: i for i, name in enumerate(names)}
    table[counts["cell"], counts["lang"].map(where)] = counts["n"]
    vocabulary = max(1, int((table.sum(axis=1) > 0).sum()))
    log = np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * (vocabulary + 1))
    return {"names": names, "log": log.astype(np.float32)}


def _mixtures(like: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen language (-1 for none) and its proportion, for each document of a block.

    ``like`` has a row of log-likelihoods per word; ``doc`` gives the word's document, in order.
    """
    best = np.full(n_docs, -1)
    share = np.zeros(n_docs)
    if not len(like) or not like.shape[1]:
        return best, share
    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    ids = doc[begins]
    count = np.diff(np.r_[begins, len(doc)])
    local = np.repeat(np.arange(len(ids)), count)
    top = like.max(axis=1)
    near = np.exp(like - top[:, None])
    fixed = np.add.reduceat(top.astype(np.float64), begins)

    def expect(theta: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            part = near * theta[local]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            theta = (np.add.reduceat(part, begins, axis=0) / count[:, None]).astype(np.float32)
        return theta

    def fit(theta: np.ndarray) -> np.ndarray:
        word = np.maximum((near * theta[local]).sum(axis=1), 1e-30)
        return np.add.reduceat(np.log(word).astype(np.float64), begins) + fixed

    languages = like.shape[1]
    theta = expect(np.full((len(ids), languages), 1 / languages, np.float32), 6)
    order = np.argsort(-theta, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    chosen = None
    worth = np.full(len(ids), -np.inf)
    most = max(1, int((theta > 0.01).sum(axis=1).max()))
    for k in range(1, most + 1):
        mask = place < k
        now = np.where(mask, np.maximum(theta, 1e-6), 0).astype(np.float32)
        now /= now.sum(axis=1, keepdims=True)
        if k > 1:
            now = expect(now, 4)
        # Each further language costs half the logarithm of the number of words, as in BIC.
        value = fit(now) - 0.5 * (k - 1) * np.log(count + 1.0) - 2.0 * (k - 1)
        better = value > worth
        chosen = now if chosen is None else np.where(better[:, None], now, chosen)
        worth = np.where(better, value, worth)
    best[ids] = chosen.argmax(axis=1)
    share[ids] = np.minimum(1.0, chosen.max(axis=1))
    return best, share


def _scorer(model: dict):
    names, log = model["names"], model["log"]

    def score(texts: list) -> list[list]:
        out_names: list = []
        out_share: list = []
        words: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        held = first = 0

        def flush(upto: int) -> None:
            nonlocal words, owner, held, first
            like = np.concatenate(words) if words else np.zeros((0, len(names)), np.float32)
            doc = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            best, share = _mixtures(like, doc, upto - first)
            out_names.extend(names[b] if b >= 0 else UNDETERMINED for b in best)
            out_share.extend(share.tolist())
            words, owner, held, first = [], [], 0, upto

        for i, text in enumerate(texts):
            for start in range(0, len(text or ""), PIECE):
                grams, begins = cells(text[start:start + PIECE])
                if len(begins):
                    words.append(np.add.reduceat(log[grams], begins, axis=0))
                    owner.append(np.full(len(begins), i - first))
            held += len(text or "")
            if held >= PIECE:
                flush(i + 1)
        flush(len(texts))
        return [out_names, out_share]

    return score


def identify(docs: DataFrame, model: dict, text: str = "text", keep: bool = False) -> DataFrame:
    """Adds ``lang_pred`` and ``lang_score``, the chosen language's share of the words.

    A null text, or one without letters, has ``und`` and 0, as has every text
    when nothing could be learned.  With ``keep`` the input row is the struct ``row``.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, text, [("lang_pred", "string", pa.string()), ("lang_score", "double", pa.float64())],
                    lambda: _scorer(broadcast.value), keep)


def filter_stage(docs: DataFrame, least: float = 0.34) -> DataFrame:
    """Drops documents without a determined language, or whose main one has under about a third of the words."""
    marked = identify(docs, train(docs), keep=True)
    return marked.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= least)).select("row.*")
