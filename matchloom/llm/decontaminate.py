"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a document with at most k edits shares at
least m + 1 - q - k*q character q-grams with it, and those lie on at most k + 1
neighbouring diagonals (document position minus item position).  Shared q-grams
are counted in overlapping bands of diagonals, so that one band holds any such
run whole; bands that reach the bound are verified by banded alignment.

Texts are compared in lower case with every run of other characters than letters
and digits as one space.  The benchmark is taken in blocks of bounded size.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import annotate

#: Length of the q-grams.
Q = 10
#: Edits allowed per character of an item.
EDITS = 0.08
#: Characters of benchmark text in a block; a block is what a task holds.
BLOCK = 4_000_000
#: Characters of documents looked at together; longer texts are cut with an overlap.
PIECE = 1 << 19
TABLE_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
#: One edit, in the numbers that carry a cost and a starting diagonal together.
_EDIT = np.int64(1 << 24)


@functools.cache
def _kept() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def normal(text: str | None) -> np.ndarray:
    """Code points of the compared form of a text."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(_kept()[code], code, np.uint32(32))
    space = out == 32
    doubled = space.copy()
    doubled[1:] &= space[:-1]
    if len(doubled):
        doubled[0] = space[0]
    out = out[~doubled]
    return out[:-1] if len(out) and out[-1] == 32 else out


def grams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram, built by doubling."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    have, length, base = code.astype(np.uint64), 1, _BASE
    result, covered = None, 0
    left = q
    while left:
        if left & 1:
            if result is None:
                result, covered = have, length
            else:
                covered += length
                n = len(code) - covered + 1
                result = result[:n] * np.uint64(base) + have[covered - length:][:n]
        left >>= 1
        if left:
            have = have[:-length] * np.uint64(base) + have[length:]
            length, base = 2 * length, base * base % (1 << 64)
    return result


class Index:
    """The q-grams of one block of items, with the bounds of each item.

    An item shorter than q characters in compared form is no evidence and is left out.
    """

    def __init__(self, ids: list, texts: list, q: int = Q, rate: float = EDITS):
        coded = [(i, normal(t)) for i, t in zip(ids, texts)]
        coded = [(i, c) for i, c in coded if len(c) >= q]
        self.q, self.ids, self.codes = q, [i for i, _ in coded], [c for _, c in coded]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.minimum((self.size * rate).astype(np.int64), (self.size - q) // q)
        self.need = self.size + 1 - q - self.edits * q
        self.longest = int((self.size + 4 * self.edits + 4).max()) if coded else 0
        hashed = [grams(c, q) for c in self.codes]
        every = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])
        place = np.concatenate([np.arange(len(h)) for h in hashed]) if hashed else item
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.start, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.gram * _ODD) >> np.uint64(64 - TABLE_BITS)] = True

    def search(self, code: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of all verified regions of a run of code points."""
        found = grams(code, self.q)
        at = np.flatnonzero(self.table[(found * _ODD) >> np.uint64(64 - TABLE_BITS)])
        if not len(at):
            return []
        slot = np.minimum(np.searchsorted(self.gram, found[at]), len(self.gram) - 1)
        same = self.gram[slot] == found[at]
        at, slot = at[same], slot[same]
        count = self.count[slot]
        if not len(at):
            return []
        shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row = np.repeat(self.start[slot], count) + shift
        item = self.item[row]
        begin = np.repeat(at, count) - self.place[row]
        width = self.edits[item] + 1
        band = np.floor_divide(begin, width)
        # Two bands overlap on every diagonal: band b covers widths b and b + 1.
        key = np.concatenate([(item << 40) + (band + (1 << 20)), (item << 40) + (band - 1 + (1 << 20))])
        key, hits = np.unique(key, return_counts=True)
        item, band = key >> 40, (key & ((1 << 40) - 1)) - (1 << 20)
        enough = hits >= self.need[item]
        return self._verify(code, item[enough], band[enough])

    def _verify(self, code: np.ndarray, items: np.ndarray, bands: np.ndarray) -> list:
        out = []
        for at in range(0, len(items), 256):
            item, band = items[at:at + 256], bands[at:at + 256]
            edits, size = self.edits[item], self.size[item]
            first = band * (edits + 1) - edits
            columns = int((4 * edits + 3).max())
            rows = int(size.max())
            text = np.full((len(item), rows), 1, np.uint32)
            for r, i in enumerate(item):
                text[r, :size[r]] = self.codes[i]
            lane = np.arange(columns)
            ours = lane[None, :] < (4 * edits + 3)[:, None]
            # A start is free on the diagonals of the band itself, not on the margins around it.
            inner = (lane[None, :] >= edits[:, None]) & (lane[None, :] < (3 * edits + 2)[:, None])
            far = _EDIT * 1_000_000
            cost = np.where(inner & ours, lane[None, :].astype(np.int64), far)
            end = np.full((len(item), columns), far)
            step = lane[None, :] * _EDIT
            padded = len(code)
            for row in range(rows):
                place = first[:, None] + lane[None, :] + row
                valid = (place >= 0) & (place < padded)
                char = np.where(valid, code[np.clip(place, 0, padded - 1)], 0)
                across = cost + np.where(char == text[:, row:row + 1], 0, _EDIT)
                skip = np.full_like(cost, far)
                skip[:, :-1] = cost[:, 1:] + _EDIT
                cost = np.where(ours, np.minimum(across, skip), far)
                # Document characters that the item lacks: a running minimum along the row.
                cost = np.minimum.accumulate(cost - step, axis=1) + step
                done = size == row + 1
                if done.any():
                    end[done] = np.where(ours[done], cost[done], far)
            least = end.min(axis=1)
            lane_end = end.argmin(axis=1)
            for r in np.flatnonzero(least // _EDIT <= edits):
                start = int(first[r] + least[r] % _EDIT)
                stop = int(first[r] + lane_end[r] + size[r])
                out.append((int(item[r]), int(least[r] // _EDIT), max(0, start), min(stop, padded)))
        return out


def matches(index: Index, texts: list) -> list[dict[int, tuple[int, int, int]]]:
    """For each text: item -> (edits, start, end) of its best region, the first of equals.

    Short texts are laid end to end with a gap that no region within the edit
    budget can cross; long ones are cut into pieces that overlap by the longest item.
    """
    best: list[dict] = [{} for _ in texts]
    pieces: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal pieces, held
        if not pieces:
            return
        gap = np.zeros(index.longest + 1, np.uint32)
        offsets, run, at = [], [], 0
        for _, _, code in pieces:
            offsets.append(at)
            run += [code, gap]
            at += len(code) + len(gap)
        offsets_ = np.array(offsets)
        for item, edits, start, end in index.search(np.concatenate(run)):
            piece = int(np.searchsorted(offsets_, (start + end) // 2, side="right")) - 1
            doc, shift, code = pieces[piece]
            begin = shift + max(0, start - offsets[piece])
            stop = shift + min(len(code), end - offsets[piece])
            value = (edits, begin, stop)
            if item not in best[doc] or value < best[doc][item]:
                best[doc][item] = value
        pieces, held = [], 0

    if index.ids:
        for i, text in enumerate(texts):
            code = normal(text)
            if len(code) < index.q:
                continue
            for start in range(0, max(1, len(code) - index.longest), PIECE):
                part = code[start:start + PIECE + index.longest]
                pieces.append((i, start, part))
                held += len(part) + index.longest
                if held >= PIECE:
                    flush()
        flush()
    return best


def blocks(benchmark: DataFrame, block: int = BLOCK) -> list[Index]:
    """The benchmark as indexes of about ``block`` characters each; null texts are left out."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // block))
    out = []
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy(
            "item_id", "text").toPandas()
        out.append(Index([None if r is None or r != r else int(r) for r in rows["item_id"]], list(rows["text"])))
    return [b for b in out if b.ids]


MATCHES = "array<struct<item_id:bigint,edits:int,start:int,end:int,item_chars:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()),
                             ("end", pa.int32()), ("item_chars", pa.int32())]))


def annotate_block(docs: DataFrame, index: Index, keep: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        held = shared.value

        def score(texts):
            return [[[{"item_id": held.ids[i], "edits": e, "start": s, "end": t, "item_chars": int(held.size[i])}
                      for i, (e, s, t) in sorted(m.items())] for m in matches(held, texts)]]
        return score

    return annotate(docs, "text", [("found", MATCHES, _ARROW)], make, keep)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that occurs in it within the edit budget.

    ``doc_id, item_id, edits, start, end, item_chars``; positions are in compared
    form.  Null and empty texts match nothing; repeated rows match each for itself.
    """
    parts = [annotate_block(docs.select("doc_id", "text"), index).select("doc_id", F.inline("found"))
             for index in blocks(benchmark)]
    if not parts:
        return docs.select("doc_id").limit(0).select("doc_id", *[
            F.lit(None).cast(kind).alias(name) for name, kind in (
                ("item_id", "long"), ("edits", "int"), ("start", "int"), ("end", "int"), ("item_chars", "int"))])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def filter_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item occurs."""
    for index in blocks(benchmark):
        docs = annotate_block(docs, index, keep=True).where(F.size("found") == 0).select("row.*")
    return docs
