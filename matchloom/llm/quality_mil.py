"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage has dense features, is encoded,
and gets a weight from gated attention (a tanh unit times a sigmoid unit); the
document is scored on the weighted mean of its encoded passages.  Weights of
encoder, attention and classifier are learned together from document labels.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm.common import annotate, bounded_sample, labelled, with_text
from matchloom.session import materialised

#: At most this many labelled documents are learned from, chosen by a hash of the id.
TRAIN_ROWS = 4000
#: Words of a passage; the last one of a text may be shorter.
PASSAGE = 48
ENCODED, GATE = 12, 8
ROUNDS, STEP, DECAY = 240, 0.03, 1e-4
SEED = 7
NAMES = ["word_length", "capitals", "digits", "stops", "signs", "bars", "exclamations", "distinct", "repeated",
         "lines", "wide", "short", "upper_words", "length"]
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_STOPS = b".,;:?"
_SIGNS = b"#$%&*@^~+=<>/\\_{}[]"
_WIDE = bytes(range(128, 256))


def passages(text: str | None) -> list[list[float]]:
    """Features of every passage of a whole text; a text without words is one passage of zeros."""
    words = (text or "").split()
    if not words:
        return [[0.0] * len(NAMES)]
    out = []
    lines = (text or "").count("\n") / len(words)
    for start in range(0, len(words), PASSAGE):
        part = words[start:start + PASSAGE]
        n = len(part)
        data = " ".join(part).encode("utf-8", "replace")
        size = len(data)

        def share(kind: bytes) -> float:
            return (size - len(data.translate(None, kind))) / size

        out.append([
            (size - n + 1) / n / 10, share(_UPPER), share(_DIGITS), share(_STOPS), share(_SIGNS), data.count(b"|") / n,
            data.count(b"!") / n, len(set(part)) / n, sum(map(eq, part, part[1:])) / n, min(1.0, lines), share(_WIDE),
            sum(len(w) < 3 for w in part) / n, sum(map(str.isupper, part)) / n, math.log1p(n) / 4])
    return out


class Attention:
    """Encoder, gated attention and classifier as arrays, with their gradients."""

    SHAPES = {"w1": (len(NAMES), ENCODED), "b1": (ENCODED,), "v": (ENCODED, GATE), "u": (ENCODED, GATE), "a": (GATE,),
              "c": (ENCODED,), "b": ()}

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.p = {k: rng.normal(0, 1 / math.sqrt(s[0]), s) if len(s) == 2 or k in "ac" else np.zeros(s)
                  for k, s in self.SHAPES.items()}

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, dict]:
        """Document logits; ``begin`` has the first passage of each document."""
        p = self.p
        size = np.diff(np.r_[begin, len(x)])
        doc = np.repeat(np.arange(len(begin)), size)
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[doc])
        weight = e / np.add.reduceat(e, begin)[doc]
        z = np.add.reduceat(weight[:, None] * h, begin, axis=0)
        return z @ p["c"] + p["b"], {"x": x, "h": h, "t": t, "g": g, "w": weight, "z": z, "doc": doc, "begin": begin}

    def gradient(self, s: dict, slope: np.ndarray) -> dict:
        """Gradients for the loss's slope at each logit."""
        p, doc = self.p, s["doc"]
        dz = slope[:, None] * p["c"]
        dw = (dz[doc] * s["h"]).sum(axis=1)
        de = s["w"] * (dw - np.add.reduceat(s["w"] * dw, s["begin"])[doc])
        dg = de[:, None] * p["a"]
        dv, du = dg * s["g"] * (1 - s["t"] ** 2), dg * s["t"] * s["g"] * (1 - s["g"])
        dh = s["w"][:, None] * dz[doc] + dv @ p["v"].T + du @ p["u"].T
        dx = dh * (1 - s["h"] ** 2)
        return {"w1": s["x"].T @ dx, "b1": dx.sum(axis=0), "v": s["h"].T @ dv, "u": s["h"].T @ du,
                "a": de @ (s["t"] * s["g"]), "c": slope @ s["z"], "b": slope.sum()}

    def fit(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> None:
        """Adam on the mean log loss, with weight decay."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for round_ in range(1, ROUNDS + 1):
            logit, state = self.forward(x, begin)
            grad = self.gradient(state, (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y))
            for k, g in grad.items():
                g = g + DECAY * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                step = first[k] / (1 - 0.9 ** round_) / (np.sqrt(second[k] / (1 - 0.999 ** round_)) + 1e-8)
                self.p[k] = self.p[k] - STEP * step

    def scores(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, begin)[0], -30, 30)))


def bags(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts one below the other, and where each text's begin."""
    each = [passages(t) for t in texts]
    begin = np.cumsum([0] + [len(b) for b in each])[:-1]
    return np.array([p for b in each for p in b], np.float64), begin


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> Attention | float:
    """Fits on at most ``rows`` labelled documents whose remainder is not ``held``.

    With labels of one class only, or none, the result is their mean (0 without any).
    """
    wanted = bounded_sample(labelled(labels, "quality", modulus, held), "doc_id", rows)
    sample = with_text(docs, wanted).mapInArrow(_sampled, "doc_id long, y int, bag array<array<double>>")
    known = materialised(sample, "quality-sample").orderBy("doc_id").toPandas()
    y = known["y"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    parts = [np.array([list(p) for p in b]) for b in known["bag"]]
    x = np.concatenate(parts)
    begin = np.cumsum([0] + [len(p) for p in parts])[:-1]
    model = Attention(x.mean(axis=0), x.std(axis=0) + 1e-6)
    model.fit(x, begin, y)
    return model


def _sampled(batches):
    kind = pa.list_(pa.list_(pa.float64()))
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()),
             pa.array([passages(t) for t in batch.column("text").to_pylist()], kind)], ["doc_id", "y", "bag"])


def score(docs: DataFrame, model: Attention | float, keep: bool = False) -> DataFrame:
    """Adds ``quality_score`` (0 to 1); null and empty texts are one empty passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value

        def run(texts):
            if isinstance(held, float):
                return [[held] * len(texts)]
            out: list = []
            for start in range(0, len(texts), 512):
                x, begin = bags(texts[start:start + 512])
                out += held.scores(x, begin).tolist()
            return [out]
        return run

    return annotate(docs, "text", [("quality_score", "double", pa.float64())], make, keep)
