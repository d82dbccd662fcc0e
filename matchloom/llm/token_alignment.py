"""Alignment of two tokenizers' tokens over the same text, by diagonal run skipping.

Both tokenizers cut the same bytes, so tokens are known by their end offsets.
While the ends of both sides agree one to one, the index shift between the sides
is constant: exponential probing compares slices of the two end arrays at that
shift, doubling while they are equal and halving back to the first difference,
so a stretch costs the logarithm of its length.  Where the ends differ, the side
that lags steps until the ends meet again; that irregular group sets the new
shift.  Every overlapping pair of tokens is a link.

A pair's count is the number of documents that hold it linked.  Documents' links
are written as a table; counts are an aggregate of it that is combined before the
shuffle, and come back to the documents in a join.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.session import materialised

#: Public pretokenisation pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The fast encoder's pattern engine gives up on longer runs of white space; such texts take the other one.
SPACES = re.compile(r"\s{512}")
#: Characters encoded at a time, so that a batch of texts needs bounded memory.
PIECE = 1 << 20
#: Pair counts are broadcast up to this many rows, else joined by a shuffle of the links.
HELD_PAIRS = 1_000_000


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE from its JSON file."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._other = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): rank
                 for token, rank in spec["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (1 + max(spec["model"]["vocab"].values()))
        for token, rank in ranks.items():
            self.bytes[rank] = token
        # Ids of this vocabulary stand in order of their merges, so they are the ranks.
        self._fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._slow(t) if SPACES.search(t) else self._fast.encode_ordinary(t) for t in texts]

    def _slow(self, text: str) -> list[int]:
        if self._other is None:
            from tokenizers import Tokenizer
            self._other = Tokenizer.from_file(self.path)
            self._other.encode_special_tokens = True
        return self._other.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B: a piece model with byte fallback, which adds a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self._model.get_piece_size())
        self.bytes = [bytes([int(self._model.id_to_piece(i)[3:-1], 16)]) if self._model.is_byte(i)
                      else self._model.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Alignment:
    """Tokens of both sides, and the groups between offsets where tokens of both end.

    ``past_a`` and ``past_b`` hold where each group's tokens end, as token indexes;
    ``link_a`` and ``link_b`` the token indexes of all overlapping pairs.
    """
    a: np.ndarray
    b: np.ndarray
    past_a: np.ndarray
    past_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Groups and links of two token arrays whose last end offsets agree."""
    raw_a, raw_b = ends_a.astype("<u8").tobytes(), ends_b.astype("<u8").tobytes()
    at_a, at_b = ends_a.tolist(), ends_b.tolist()
    number = int.from_bytes
    # One-to-one stretches: their starts and length.  Irregular groups: their four bounds.  Both flat.
    runs, knots = [], []
    i = j = 0
    total = len(at_a)
    while i < total:
        here, there, step = 8 * i, 8 * j, 128
        stop = len(raw_a)
        while here < stop:
            # A slice past the end of one side reads as zeros there, which no end is.
            apart = (number(raw_a[here:here + step], "little") ^ number(raw_b[there:there + step], "little"))
            if apart:
                here += ((apart & -apart).bit_length() - 1) // 64 * 8
                break
            here, there, step = here + step, there + step, 2 * step
        run = min(here // 8, total) - i
        if run:
            runs += (i, j, run)
            i, j = i + run, j + run
            if i >= total:
                break
        first_a, first_b = i, j
        x, y = at_a[i], at_b[j]
        while x != y:
            if x < y:
                i += 1
                x = at_a[i]
            else:
                j += 1
                y = at_b[j]
        i, j = i + 1, j + 1
        knots += (first_a, i, first_b, j)

    start_a, start_b, size = np.array(runs, np.int64).reshape(-1, 3).T
    low_a, high_a, low_b, high_b = np.array(knots, np.int64).reshape(-1, 4).T
    one_a, one_b = ranges(start_a, size), ranges(start_b, size)
    # Each end inside an irregular group begins one more link: the next token beside the other side's token there.
    inner_a, inner_b = ranges(low_a, high_a - low_a - 1), ranges(low_b, high_b - low_b - 1)
    link_a = [one_a, low_a, inner_a + 1, np.searchsorted(ends_a, ends_b[inner_b], "right")]
    link_b = [one_b, low_b, np.searchsorted(ends_b, ends_a[inner_a], "right"), inner_b + 1]
    past_a, past_b = (np.sort(np.concatenate(x)) for x in ((one_a + 1, high_a), (one_b + 1, high_b)))
    return Alignment(a, b, past_a, past_b, np.concatenate(link_a), np.concatenate(link_b))


class Aligner:
    """Encodes texts with both tokenizers and aligns their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.side_a, self.side_b = ByteLevel(path_a), Pieces(path_b)
        self._length_a = np.array([len(t) for t in self.side_a.bytes], np.int64)
        self._length_b = np.array([len(t) for t in self.side_b.bytes], np.int64)

    def __call__(self, texts: list[str | None]) -> Iterator[Alignment]:
        """One alignment per text; null, empty and not faithfully encoded texts have no tokens."""
        full = [t for t in texts if t]
        found = iter(zip(full, self.side_a.encode([" " + t for t in full]), self.side_b.encode(full)) if full else ())
        for text in texts:
            yield self._aligned(*next(found) if text else ("", [], []))

    def _aligned(self, text: str, a: list[int], b: list[int]) -> Alignment:
        whole = b" " + text.encode()
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self._length_a[ids_a]), np.cumsum(self._length_b[ids_b])
        # Byte-level tokens are cut out of the text's own bytes, so their length tells if all are there.
        if not a or ends_a[-1] != len(whole) or b"".join(map(self.side_b.bytes.__getitem__, b)) != whole:
            ids_a = ids_b = ends_a = ends_b = np.zeros(0, np.int64)
        return align(ids_a, ids_b, ends_a, ends_b)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE`` characters; one longer text is a range of its own."""
    start = held = 0
    for k, text in enumerate(texts):
        size = len(text or "")
        if k > start and held + size > PIECE:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


#: Name, SQL type, and a function from alignments to a column.
Derived = tuple[str, str, Callable[[list[Alignment]], pa.Array]]


def aligned(docs: DataFrame, derive: list[Derived], text: str = "text",
            path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """All columns of ``docs`` as a struct ``row``, a unique long ``place``, and one column per ``derive``.

    The functions of ``derive`` are evaluated in the task that aligns.  ``place`` is
    unique within one run of the plan: write the result before it is read twice.
    """
    path_a = path_a or vocabulary("byte_bpe_50k.json")
    path_b = path_b or vocabulary("piece_bpe_32k.model")
    table = docs.select(F.struct("*").alias("row"), F.col(text).alias("_text"))
    schema = T.StructType([table.schema["row"]]).add("place", "long")
    for name, kind, _ in derive:
        schema = schema.add(T.StructType.fromDDL(f"{name} {kind}")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Aligner(path_a, path_b)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for start, end in pieces(texts):
                found = list(make(texts[start:end]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(start, end - start),
                     pa.array(range(place + start, place + end), pa.int64())]
                    + [column(found) for _, _, column in derive], schema.names)
            place += len(texts)

    return table.mapInArrow(run, schema)


def lists(values: list[np.ndarray], kind: pa.DataType = pa.int32()) -> pa.Array:
    """A list per array."""
    return pa.ListArray.from_arrays(_offsets(values), pa.array(np.concatenate([[], *values]).astype(np.int64), kind))


def _offsets(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32))


def structs(rows: list[list[np.ndarray]], names: list[str]) -> pa.Array:
    """A list of structs per entry of ``rows``, which has an array for each name."""
    fields = [pa.array(np.concatenate([[], *c]).astype(np.int64), pa.int32()) for c in zip(*rows)]
    return pa.ListArray.from_arrays(_offsets([r[0] for r in rows]), pa.StructArray.from_arrays(fields, names))


def numbers(of: Callable[[Alignment], int]) -> Callable[[list[Alignment]], pa.Array]:
    return lambda found: pa.array([of(x) for x in found], pa.int64())


def spans(x: Alignment) -> list[np.ndarray]:
    """Each group's token ranges: first A, past A, first B, past B."""
    return [np.concatenate([[0], x.past_a])[:-1], x.past_a, np.concatenate([[0], x.past_b])[:-1], x.past_b]


SPANS: list[Derived] = [
    ("a_ids", "array<int>", lambda found: lists([x.a for x in found])),
    ("b_ids", "array<int>", lambda found: lists([x.b for x in found])),
    ("groups", "array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>",
     lambda found: structs([spans(x) for x in found], ["a_from", "a_to", "b_from", "b_to"])),
]


def align_documents(docs: DataFrame, text: str = "text", **paths: str) -> DataFrame:
    """``row``, ``place``, token ids ``a_ids`` and ``b_ids``, and ``groups`` as token ranges."""
    return aligned(docs, SPANS, text, **paths)


@functools.cache
def _signs(size: int) -> list[bytes]:
    """Each id below ``size`` with a comma, then with a bar, then with a semicolon behind it."""
    return [b"%d%c" % (i, sign) for sign in b",|;" for i in range(size)]


def shown(x: Alignment) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group in order."""
    if not len(x.a):
        return b""
    size = 1 << int(max(x.a.max(), x.b.max(), (1 << 16) - 1)).bit_length()
    last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    last_a[x.past_a - 1], last_b[x.past_b - 1] = size, 2 * size
    # A's tokens stand behind all tokens of earlier groups, B's behind those of their own group's A too.
    sizes_a, sizes_b = np.diff(x.past_a, prepend=0), np.diff(x.past_b, prepend=0)
    out = np.empty(len(x.a) + len(x.b), np.int64)
    out[np.arange(len(x.a)) + np.repeat(x.past_b - sizes_b, sizes_a)] = x.a + last_a
    out[np.arange(len(x.b)) + np.repeat(x.past_a, sizes_b)] = x.b + last_b
    return b"".join(map(_signs(size).__getitem__, out.tolist()))[:-1]


def digest(x: Alignment) -> str:
    return hashlib.sha256(shown(x)).hexdigest() if len(x.a) else ""


def pair_links(x: Alignment) -> list[np.ndarray]:
    """The distinct linked id pairs of a document and how often each is linked."""
    keys, times = np.unique((x.a[x.link_a] << 32) | x.b[x.link_b], return_counts=True)
    return [keys >> 32, keys & 0xFFFFFFFF, times]


LINKS: list[Derived] = [
    ("n_a", "long", numbers(lambda x: len(x.a))),
    ("n_b", "long", numbers(lambda x: len(x.b))),
    ("n_groups", "long", numbers(lambda x: len(x.past_a))),
    ("n_links", "long", numbers(lambda x: len(x.link_a))),
    ("groups_sha256", "string", lambda found: pa.array([digest(x) for x in found], pa.string())),
    ("links", "array<struct<a:int,b:int,times:int>>",
     lambda found: structs([pair_links(x) for x in found], ["a", "b", "times"])),
]


def pair_counts(linked: DataFrame) -> DataFrame:
    """``a, b, docs, best``: documents that hold each id pair linked, and whether that is its A id's highest."""
    counts = materialised(linked.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(
        F.count(F.lit(1)).alias("docs")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return materialised(counts.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best")),
                        "pair-best")


def best_links(linked: DataFrame, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """``place, n_best, count_sum`` for each row of ``linked`` that has links.

    The pair table stands beside every task if it is small, which is checked;
    beyond ``held_pairs`` rows the links are dealt out by pair, where a hot pair is
    split by the adaptive skew join, for the pair table has one row for it.
    """
    counts = pair_counts(linked)
    hint = "broadcast" if counts.count() <= held_pairs else "merge"
    links = linked.select("place", F.explode("links").alias("l")).select("place", "l.*")
    met = links.join(counts.hint(hint), ["a", "b"])
    return met.groupBy("place").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("docs") * F.col("times")).alias("count_sum"))


def alignments(docs: DataFrame, text: str = "text", id_col: str = "doc_id", held_pairs: int = HELD_PAIRS,
               **paths: str) -> DataFrame:
    """Per row: id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Every row counts as a document, rows with equal or null ids too.  Null and
    empty texts, and texts that a tokenizer does not give back byte by byte, have
    zeros and an empty digest.  An empty table gives no rows; other columns, of
    any name, are not read.
    """
    linked = materialised(aligned(docs.select(id_col, text), LINKS, text, **paths).select(
        F.col(f"row.{id_col}").alias("_id"), "place", *[name for name, *_ in LINKS]), "alignments")
    sums = best_links(linked, held_pairs)

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return linked.drop("links").join(sums, "place", "left").select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", number("n_best"), number("count_sum"),
        "groups_sha256")
