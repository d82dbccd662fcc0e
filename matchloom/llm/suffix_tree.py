"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of up to ``ORDER`` words.  A context is kept if its own
next-word distribution diverges from that of its longest kept suffix by more
than its parameters cost.  A kept state has its frequent continuations
(discounted) and gives what is left to its suffix state, so that each state's
probabilities sum to one; a text is scored at the longest kept suffix of what
precedes each word.

Every run of words that occurs ``LEAST`` times or more can be an arc, at any size
of the corpus, so the tree grows with it and is a set of tables: ``levels`` counts
the runs and decides on the contexts, ``weights`` has what a run adds to the score
of a text in which it stands.

Documents lie in ``pieces`` of some MB.  A piece sends its distinct runs to buckets
of their keys, packed; a bucket adds up the counts and answers each piece which
of its runs are frequent, so the next length is counted for exactly those whose parts are.
One of the pieces with a frequent run, named by the bucket, hands it on as a
row.  In the end the pieces ask for the weights of their runs in the same way.
Nothing that grows with the corpus is broadcast.

Words and runs are known by keys of 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import remainder
from matchloom.session import materialised

#: Least probability of a word in the vocabulary of the tree in memory.
HEAD = 2e-6
#: Runs whose weights one task holds, about; no result depends on it.
HELD_RUNS = 500_000
#: Bytes of text in a piece, about, and the longest word in bytes whose key comes from sums.
PIECE = 1 << 22
LONG = 64
#: Turns in which the pieces ask for weights.
TURNS = 2
#: In place of a length, marks the answers that are weights.
WEIGHT = 0
#: Least count of a word or a run of words in the tree.
LEAST = 4
#: Longest context in words.
ORDER = 3
#: Taken from every count of a kept state, for what it has not seen.
DISCOUNT = 0.5
#: Distinct words a task counts before it hands them on.
HELD = 400_000
_SHIFT = 21
END = 0


def words(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, split at spaces and the ASCII controls 09 to 0D."""
    return (text or b"").lower().split()


def _word_key(word: bytes) -> int:
    """Spark's ``xxhash64`` of a word; the end of a text has that of the empty word."""
    return xxhash.xxh64_intdigest(word, 42)


def _run_key(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of a run from those of the run without its last and without its first word."""
    mixed = context * np.uint64(0x9E3779B97F4A7C15) + suffix
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (suffix >> np.uint64(7))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(32))


def _texts(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).cast(pa.binary()).to_pylist()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all documents; tasks count before the shuffle."""
    def run(batches):
        total: Counter = Counter()

        def out():
            part = pa.RecordBatch.from_arrays(
                [pa.array(list(total.keys()), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return part

        for batch in batches:
            for value in _texts(batch, text):
                total.update(words(value))
                if len(total) >= HELD:
                    yield out()
        if total:
            yield out()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words by falling count; 0 is the end of a text."""

    def __init__(self, frequent, ends: int, total: int, kinds: int, once: int, twice: int):
        self.total, self.kinds = total, kinds
        self.number = {w.encode(): i + 1 for i, w in enumerate(frequent["word"])}
        self.count = np.concatenate([[ends], frequent["n"].to_numpy(np.int64)]) if len(frequent) else np.array([ends])
        self.arcs = 1 + int((self.count[1:] >= LEAST).sum())
        self.keys = np.array([_word_key(w) for w in [b"", *self.number]], np.uint64)
        # The share of a count that is kept for words not seen, from words seen once and twice.
        self.discount = (once + 1) / (once + 2 * twice + 2)

    @classmethod
    def of(cls, total: int, kinds: int, once: int, twice: int) -> Vocabulary:
        """The counts alone, over all tokens and ends, without a list of words."""
        return cls(pd.DataFrame({"word": [], "n": []}), 0, total, kinds, once, twice)

    def base(self, count):
        return np.log10((count + 1) / (self.total + self.kinds + 1))

    def root(self, count):
        """log10 of the root's probability; a word not seen has the mass of all such words."""
        if not self.total:
            return np.zeros_like(np.asarray(count, float))
        unseen = self.discount * self.kinds / self.total
        return np.log10(np.where(count > 0, np.maximum(count - self.discount, 1e-9) / self.total, unseen))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    total = facts["n"] + ends
    least = max(LEAST, int(np.ceil(HEAD * total)))
    # At most 1 / HEAD words reach this count.
    frequent = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return Vocabulary(frequent, ends, total, facts["v"] + (ends > 0), facts["once"] + (ends == 1), facts["twice"] + (ends == 2))


def encode(docs: DataFrame, known) -> DataFrame:
    """``rid, doc_id, train, ids, rare``: a document as word numbers and its rare words with counts.

    The number of a rare word is -1 less its place among the document's rare words.
    """
    names = ["rid", "doc_id", "train", "ids", "rare"]
    rare = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))

    def run(batches):
        get = known.value.number.get
        for batch in batches:
            ids, others = [], []
            for value in _texts(batch, "text"):
                text = words(value)
                row = np.fromiter((get(w, -1) for w in text), np.int32, len(text))
                ids.append(row)
                missing = np.flatnonzero(row < 0)
                seen = Counter(text[i] for i in missing)
                place = {w: -1 - j for j, w in enumerate(seen)}
                row[missing] = [place[text[i]] for i in missing]
                others.append([{"word": w.decode(), "k": n} for w, n in seen.items()])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in ids])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("train"), listed, pa.array(others, rare)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "train", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, train boolean, ids array<int>, rare array<struct<word:string,k:bigint>>")


class Tree:
    """The model in memory, for corpora whose words are all in the vocabulary; ``levels`` makes the same one as tables.

    Levels of arcs: level k holds runs of k words as (number of the first k-1 words' run, last word)."""

    def __init__(self, known: Vocabulary):
        self.known = known
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.arc: list[np.ndarray] = []
        self.suffix: list[np.ndarray] = []
        self.kept: list[np.ndarray] = []
        self.left: list[np.ndarray] = []

    def runs(self, seq: np.ndarray) -> list[np.ndarray]:
        """For each level, the number of the run that ends at each place of ``seq``, or -1."""
        first = np.where((seq >= 0) & (seq < self.known.arcs), seq, -1).astype(np.int64)
        out = [first]
        for keys in self.keys:
            at, value = self.steps(out[-1], seq)
            now = np.full(len(seq), -1, np.int64)
            if len(keys) and len(at):
                slot = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                same = keys[slot] == value
                now[at[same]] = slot[same]
            out.append(now)
        return out

    @staticmethod
    def steps(runs: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run can be one word longer, and the keys of those longer runs.

        Both the run before and the run that ends here must be frequent; nothing goes on after an end.
        """
        at = np.flatnonzero((runs[:-1] >= 0) & (runs[1:] >= 0) & (seq[:-1] != END)) + 1
        return at, (runs[at - 1] << _SHIFT) | seq[at]

    def grow(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds a level from its frequent runs, and decides which of their contexts are kept."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        context, word = keys >> _SHIFT, keys & ((1 << _SHIFT) - 1)
        above = self.counts[-1] if self.counts else self.known.count[:self.known.arcs]
        states = len(above)
        own = (counts - DISCOUNT) / above[context]
        shorter = self._shorter(context)
        parent = 10.0 ** self.log(len(self.keys), shorter, word)
        total = np.bincount(context, own, states)
        theirs = np.bincount(context, parent, states)
        rest, rest_parent = np.maximum(1 - total, 1e-9), np.maximum(1 - theirs, 1e-9)
        gain = np.bincount(context, counts * np.log(own / parent), states) + above * rest * np.log(rest / rest_parent)
        arcs = np.bincount(context, minlength=states)
        kept = (arcs > 0) & (gain > 0.5 * (arcs + 1) * np.log(max(2, self.known.total)))
        self.kept.append(kept)
        self.left.append(np.log10(rest / rest_parent))
        # The suffix of a run, as a run of the level before: its context's suffix, one word longer.
        if self.keys:
            key = (shorter << _SHIFT) | word
            self.suffix.append(np.searchsorted(self.keys[-1], key))
        else:
            self.suffix.append(word)
        self.keys.append(keys)
        self.counts.append(counts)
        self.arc.append(np.log10(own))

    def _shorter(self, context: np.ndarray) -> np.ndarray | None:
        """The states of the context without its first word; none for one word."""
        return self.suffix[-1][context] if self.keys else None

    def log(self, level: int, state: np.ndarray | None, word: np.ndarray) -> np.ndarray:
        """log10 probability of words after contexts of ``level`` words."""
        if level == 0:
            return self.known.root(self.known.count[word])
        shorter = self.suffix[level - 2][state] if level > 1 else None
        out = self.log(level - 1, shorter, word)
        keys = self.keys[level - 1]
        if not len(keys):
            return out
        key = (state << _SHIFT) | word
        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        here = np.where(keys[slot] == key, self.arc[level - 1][slot], out + self.left[level - 1][state])
        return np.where(self.kept[level - 1][state], here, out)

    def score(self, seq: np.ndarray) -> np.ndarray:
        """log10 probability at each place; for a rare word without the root's part."""
        runs = self.runs(seq)
        count = self.known.count[np.maximum(seq, 0)]
        out = np.where(seq >= 0, self.known.root(count), 0.0)
        for level in range(1, len(self.keys) + 1):
            state = np.full(len(seq), -1, np.int64)
            state[1:] = np.where(seq[:-1] != END, runs[level - 1][:-1], -1)
            at = np.flatnonzero(state >= 0)
            at = at[self.kept[level - 1][state[at]]]
            arc = runs[level][at]
            out[at] = np.where(arc >= 0, self.arc[level - 1][np.maximum(arc, 0)] if len(self.arc[level - 1]) else 0.0,
                               out[at] + self.left[level - 1][state[at]])
        return out


def _sequence(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All documents of a batch as one run of word numbers with an end after each, and where each begins."""
    size = np.asarray(ids.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = ids.flatten().to_numpy()
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    seq = np.full(begin[-1], END, np.int64)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    seq[inside] = flat
    return seq, begin[:-1]


def _pieces(batch: pa.RecordBatch, name: str, most: int = 1 << 18):
    """Slices of a batch with about ``most`` words each, so that arrays stay small."""
    size = np.asarray(batch.column(name).value_lengths().to_numpy(zero_copy_only=False), np.int64)
    start = held = 0
    for i, n in enumerate(size):
        held += int(n) + 1
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def grow(coded: DataFrame, known: Vocabulary, order: int = ORDER) -> Tree:
    """The tree of all training documents in memory, a level at a time."""
    spark = coded.sparkSession
    tree = Tree(known)
    for _ in range(order):
        shared = spark.sparkContext.broadcast(tree)

        def run(batches, shared=shared):
            for batch in batches:
                for part in _pieces(batch, "ids"):
                    seq, _ = _sequence(part.column("ids"))
                    _, keys = Tree.steps(shared.value.runs(seq)[-1], seq)
                    key, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

        frequent = coded.where("train").select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(
            F.sum("n").alias("n")).where(F.col("n") >= LEAST).toPandas()
        tree.grow(frequent["key"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64))
        if not len(frequent):
            break
    return tree


def _longer(seq: np.ndarray, keys: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the keys of the runs that end at each place, those one word longer; nothing goes on after an end."""
    more, good = np.zeros_like(keys), np.zeros_like(ok)
    good[1:] = ok[1:] & ok[:-1] & (seq[:-1] != END)
    at = np.flatnonzero(good)
    more[at] = _run_key(keys[at - 1], keys[at])
    return more, good


def _constants(seed: int, size: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([i]), seed) for i in range(size)], np.uint64)


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LETTER = np.where(_SPACE, np.uint64(0), _constants(1, 256)[[c + 32 if 65 <= c <= 90 else c for c in range(256)]])
_PLACE = _constants(2, LONG) | np.uint64(1)
_END_KEY = np.uint64(0xA0761D6478BD642F)


def _text_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words of some texts with an end after each, and the number of tokens of each text.

    A key is the sum of a constant of each byte times one of its place, mixed with the length; longer words have their xxHash.
    """
    data = b" ".join([*texts, b""])
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]])
    start, stop = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    length = stop - start
    if len(start):
        within = np.arange(start[0], len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
        found = np.add.reduceat(_LETTER[raw[start[0]:]] * _PLACE[np.minimum(within, LONG - 1)], start - start[0])
        found = _run_key(found, length.astype(np.uint64))
        for i in np.flatnonzero(length > LONG):
            found[i] = _word_key(data[start[i]:stop[i]].lower())
    else:
        found = np.zeros(0, np.uint64)
    last = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    size = np.diff(last, prepend=0) + 1
    keys = np.full(len(start) + len(texts), _END_KEY, np.uint64)
    inside = np.ones(len(keys), bool)
    inside[np.cumsum(size) - 1] = False
    keys[inside] = found
    return keys, size


def pieces(rows: DataFrame) -> DataFrame:
    """``piece, doc_id, train, size, words, seq``: neighbouring documents of about ``PIECE`` bytes as one row.

    ``size`` has their numbers of tokens, ``words`` the keys of their distinct words by falling count, ``seq`` the place of each token among these.
    """
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "train", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = _texts(batch, "text")
            block = np.cumsum([len(t) + 1 for t in texts]) // PIECE
            cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(texts))
            for start, stop in zip(cuts[:-1], cuts[1:]):
                keys, size = _text_keys(texts[start:stop])
                distinct, seq, n = np.unique(keys, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order))
                part, ends = batch.slice(start, stop - start), pa.array([0, stop - start], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid")[:1], *(pa.ListArray.from_arrays(ends, v) for v in (
                        part.column("doc_id"), part.column("train"), pa.array(size.astype(np.int64)))),
                     pa.array([distinct[order].tobytes()], pa.binary()), pa.array([_pack(place[seq])], pa.binary())],
                    ["piece", "doc_id", "train", "size", "words", "seq"])

    return rows.mapInArrow(run, f"piece long, doc_id array<{kind}>, train array<boolean>, size array<long>, words binary, seq binary")


def _pack(values: np.ndarray) -> bytes:
    """Values that repeat, compressed: their bytes are put together by place first."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes | None, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little") if blob else 0
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _packed(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    """Neighbouring values as one binary value from each cut to the next."""
    return pa.array([_pack(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())


def _keys(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that pieces sent as steps, and where those of each piece begin and the last end."""
    found = [np.cumsum(_unpack(v, np.uint64), dtype=np.uint64) for v in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.cumsum([0, *map(len, found)])


class Piece:
    """A piece and what it was answered for the runs of each length, in the order of their keys."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.id = batch.column("piece")[i].as_py()
        self.size = batch.column("size")[i].values.to_numpy()
        words = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
        order = np.argsort(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.seq = words[order], place[_unpack(batch.column("seq")[i].as_py(), np.uint32)]
        self.doc_id, self.train = batch.column("doc_id")[i].values, batch.column("train")[i].values
        given = {}
        if "answers" in batch.schema.names:
            for a in sorted(batch.column("answers")[i].as_py() or [], key=lambda a: (a["length"], a["bucket"])):
                given.setdefault(a["length"], []).append(a)
        self.answers = given

    def kind(self, length: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint8), *(_unpack(a["kind"], np.uint8) for a in self.answers.get(length, ()))])

    def value(self, length: int, kind=np.int64) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(_unpack(a["value"], kind) for a in self.answers.get(length, ()))])

    def learned(self) -> np.ndarray:
        return np.repeat(self.train.to_numpy(zero_copy_only=False), self.size)

    def runs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length up to ``most``: the key of the run that ends at each token, and the places of those whose
        parts are frequent, with their keys in order and without repeats and the number of each place among these.

        Runs of two words are taken whatever their parts are: nearly all words are frequent, so no answer is waited for.
        """
        keys, ok = self.words[self.seq], np.ones(len(self.seq), bool)
        mark = np.where(keys == _END_KEY, END, 1)
        for length in range(1, most + 1):
            if length == 1:
                at, distinct, number = np.arange(len(keys)), self.words, self.seq
            else:
                keys, ok = _longer(mark, keys, ok)
                at = np.flatnonzero(ok)
                distinct, number = np.unique(keys[at], return_inverse=True)
            yield keys, at, distinct, number
            if 1 < length < most:
                ok[at] = self.kind(length)[number] > 0


def _each(batches) -> Iterator[Piece]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Piece(batch, i)


def answered(coded: DataFrame, answers: list[DataFrame], valued: tuple[int, ...] = ()) -> DataFrame:
    """The pieces with what they were answered; the values only of the lengths in ``valued``."""
    every = answers[0].select("piece", "length", "bucket", "kind", "value")
    for more in answers[1:]:
        every = every.unionByName(more.select(every.columns))
    every = every.withColumn("value", F.when(F.col("length").isin(*valued), F.col("value"))) if valued else every.withColumn(
        "value", F.lit(None).cast("binary"))
    return coded.join(every.groupBy("piece").agg(F.collect_list(F.struct("length", "bucket", "kind", "value")).alias("answers")), "piece")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of all keys."""
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _asked(piece: int, keys: np.ndarray, buckets: int, counts: np.ndarray) -> pa.RecordBatch:
    """What a piece asks of each bucket: its keys there, and how often each stands in its training documents."""
    bucket = _bucket(keys, buckets)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[:len(bucket)])
    cuts = np.append(first, len(keys))
    # Keys in order are sent as steps, which take 6 of 8 bytes or so.
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[first] = keys[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first].astype(np.int64)), pa.array(np.full(len(first), piece)), _packed(cuts, steps), _packed(cuts, counts)],
        ["bucket", "piece", "keys", "counts"])


_ASKED = "bucket long, piece long, keys binary, counts binary"


def totals(coded: DataFrame, length: int, buckets: int) -> DataFrame:
    """How often the runs of a length occur in training: one row for each piece and bucket.

    For each run the piece asked about, ``kind`` is 0 if it is not frequent, 2 if this piece is to hand it on, else 1; ``value``
    has the counts of those to hand on, for words of all.  ``facts`` (in one row of a bucket) has for all distinct runs
    the sum, their number, and how many occur once and twice.
    """
    def ask(batches):
        for piece in _each(batches):
            *_, (_, at, distinct, number) = piece.runs(length)
            counts = np.bincount(number[piece.learned()[at]], minlength=len(distinct)).astype(np.uint32)
            yield _asked(piece.id, distinct, buckets, counts)

    def answer(part: pa.Table) -> pa.Table:
        keys, cuts = _keys(part.column("keys"))
        counts = np.concatenate([_unpack(c, np.uint32) for c in part.column("counts").to_pylist()])
        distinct, number = np.unique(keys, return_inverse=True)
        n = np.bincount(number, counts, len(distinct)).astype(np.int64)
        first = np.zeros(len(distinct), np.int64)
        first[number[::-1]] = np.arange(len(keys))[::-1]
        kind = (n >= LEAST)[number].astype(np.uint8)
        kind[first[n >= LEAST]] = 2
        if length == 1:
            value, ends = n[number], cuts
        else:
            value, ends = n[number[kind == 2]], np.concatenate([[0], np.cumsum(kind == 2)])[cuts]
        facts = [[int(n.sum()), int((n > 0).sum()), int((n == 1).sum()), int((n == 2).sum())]] + [None] * (len(part) - 1)
        return pa.table({
            "piece": part.column("piece"), "length": pa.array(np.full(len(part), length)), "bucket": part.column("bucket"),
            "kind": _packed(cuts, kind), "value": _packed(ends, value), "facts": pa.array(facts, pa.list_(pa.int64()))})

    return coded.mapInArrow(ask, _ASKED).groupBy("bucket").applyInArrow(
        answer, "piece long, length long, bucket long, kind binary, value binary, facts array<long>")


def frequent(coded: DataFrame, length: int) -> DataFrame:
    """``context, suffix, key, n`` of each frequent run of a length, by the piece that is to hand it on."""
    def run(batches):
        for piece in _each(batches):
            keys = None
            for now, at, distinct, number in piece.runs(length):
                before, keys = keys, now
            n = piece.value(length)
            mine = piece.kind(length) == 2
            if length == 1:
                pair = distinct[mine], distinct[mine]
            else:
                place = np.zeros(len(distinct), np.int64)
                place[number] = at
                end = place[mine]
                pair = before[end - 1], before[end]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v.view(np.int64)) for v in (*pair, distinct[mine])), pa.array(n[mine] if length == 1 else n)],
                ["context", "suffix", "key", "n"])

    return coded.mapInArrow(run, "context long, suffix long, key long, n long")


def _discard(tables: list[DataFrame]) -> None:
    """Deletes the folders of written tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def levels(coded: DataFrame, words: DataFrame, known: Vocabulary, buckets: int, order: int = ORDER) -> tuple[DataFrame, list[DataFrame]]:
    """``key, n, weight``: what each run in a text adds to the text's score, for the runs that add anything; and the answers.

    The score of a word is the root's, and for each context before it that is
    kept, what that context changes: the log of the state's left share, or for
    an arc its own log less that of its suffix.  So a context adds its left share wherever it
    stands, and an arc the difference from that.
    """
    root = F.log10(F.greatest(F.col("n") - known.discount, F.lit(1e-9)) / float(max(1, known.total)))
    last = materialised(frequent(answered(coded.withColumn("seq", F.lit(None).cast("binary")), [words], (1,)), 1).select("key", "n", root.alias("log")), "runs")
    answers, found, done = [words], [], [last]
    price = 0.5 * float(np.log(max(2, known.total)))
    for length in range(2, order + 2):
        asking = answered(coded, answers[1:]) if length > 2 else coded
        answers.append(materialised(totals(asking, length, buckets), "answers"))
        arcs = frequent(answered(coded, answers[1:], (length,)), length)
        arcs = arcs.join(last.select(F.col("key").alias("context"), F.col("n").alias("above")), "context").join(
            last.select(F.col("key").alias("suffix"), F.col("log").alias("parent")), "suffix")
        own = (F.col("n") - DISCOUNT) / F.col("above")
        arcs = materialised(arcs.select("context", "key", "n", "above", "parent", own.alias("own")), "arcs")
        rest, rest_parent = (F.greatest(1 - F.sum(c), F.lit(1e-9)) for c in (F.col("own"), F.pow(F.lit(10.0), F.col("parent"))))
        gain = F.sum(F.col("n") * (F.ln("own") - F.col("parent") * float(np.log(10))))
        states = arcs.groupBy("context").agg(F.first("above").alias("above"), F.count(F.lit(1)).alias("arcs"), gain.alias("gain"),
                                             rest.alias("rest"), rest_parent.alias("rest_parent"))
        share = F.col("rest") / F.col("rest_parent")
        states = materialised(states.where(F.col("gain") + F.col("above") * F.col("rest") * F.ln(share) > (F.col("arcs") + 1) * price).select(
            "context", "above", F.log10(share).alias("left_share")), "states")
        log = F.when(F.col("left_share").isNotNull(), F.log10("own")).otherwise(F.col("parent"))
        last = materialised(arcs.join(states.drop("above"), "context", "left").select(
            "key", "n", log.alias("log"), (log - F.col("parent") - F.col("left_share")).alias("weight")), "runs")
        _discard([arcs])
        done += [states, last]
        found += [states.select(F.col("context").alias("key"), F.col("above").alias("n"), F.col("left_share").alias("weight")),
                  last.where("weight is not null").select("key", "n", "weight")]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    weights = materialised(every.groupBy("key").agg(F.max("n").alias("n"), F.sum("weight").alias("weight")), "weights")
    _discard(done)
    return weights, answers


def _own_runs(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of a piece's frequent runs in order and without repeats, where they stand, and the number of each place among these."""
    keys, places = [], []
    for length, (now, at, _, number) in enumerate(piece.runs(ORDER + 1), 1):
        at = at[piece.kind(length)[number] > 0]
        keys.append(now[at])
        places.append(at)
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.concatenate(places), number


def _in_turn(keys: np.ndarray, buckets: int, turn: int) -> np.ndarray:
    return _bucket(keys, buckets) * np.uint64(TURNS) // np.uint64(buckets) == turn


def run_weights(coded: DataFrame, weights: DataFrame, buckets: int, turn: int) -> DataFrame:
    """The weights of the frequent runs of each piece, 0 for those that add nothing, by piece and bucket.

    The buckets take ``TURNS``, so that a part of all that the pieces ask lies on disk at a time.
    """
    def ask(batches):
        for piece in _each(batches):
            keys, _, _ = _own_runs(piece)
            keys = keys[_in_turn(keys, buckets, turn)]
            yield _asked(piece.id, keys, buckets, np.zeros(len(keys), np.uint8))

    def answer(part: pa.Table, given: pa.Table) -> pa.Table:
        keys, cuts = _keys(part.column("keys"))
        value = np.zeros(len(keys))
        if len(given) and len(keys):
            known = given.column("key").to_numpy().view(np.uint64)
            order = np.argsort(known)
            known = known[order]
            slot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            value = np.where(known[slot] == keys, given.column("weight").to_numpy()[order][slot], 0.0)
        return pa.table({
            "piece": part.column("piece"), "length": pa.array(np.full(len(part), WEIGHT)), "bucket": part.column("bucket"),
            "kind": pa.nulls(len(part), pa.binary()), "value": _packed(cuts, value)})

    bucket = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(buckets).cast("long"), 32)
    given = weights.select(bucket.alias("bucket"), "key", "weight").where(F.floor(F.col("bucket") * TURNS / buckets) == turn)
    return coded.mapInArrow(ask, _ASKED).groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(
        answer, "piece long, length long, bucket long, kind binary, value binary")


def run_sums(coded: DataFrame, buckets: int, turn: int) -> DataFrame:
    """What the runs of a turn add to the scores of each piece's documents, as an answer to the piece."""
    def run(batches):
        for piece in _each(batches):
            keys, at, number = _own_runs(piece)
            weight = np.zeros(len(keys))
            weight[_in_turn(keys, buckets, turn)] = piece.value(WEIGHT, np.float64)
            each = np.bincount(at, weight[number], len(piece.seq))
            sums = np.add.reduceat(each, np.cumsum(piece.size) - piece.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece.id]), pa.array([WEIGHT]), pa.array([turn]), pa.nulls(1, pa.binary()), pa.array([_pack(sums)], pa.binary())],
                ["piece", "length", "bucket", "kind", "value"])

    return coded.mapInArrow(run, "piece long, length long, bucket long, kind binary, value binary")


#: Spark deletes the shuffle files of an execution when it ends; every table here is written before it is read again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Learns from documents whose id's remainder is not ``held``; those without an
    id are never learned from.  A null text is an empty one: only its end is
    scored.  Without any training document all scores are 0.
    """
    with _cleaned(docs.sparkSession):
        return _score(docs, modulus, held)


def _score(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", modulus) != held, F.lit(False)).alias("train"),
                       F.coalesce("text", F.lit("")).alias("text"))
    coded = materialised(pieces(rows), "coded")
    tokens = coded.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda s, n: s + n))).first()[0] or 0
    buckets = max(8, min(tokens >> 20, 1024), tokens >> 23)
    words = materialised(totals(coded, 1, buckets), "answers")
    total, kinds, once, twice = (words.agg(*(F.coalesce(F.sum(F.col("facts")[i]), F.lit(0)) for i in range(4))).first())
    known = Vocabulary.of(total, kinds, once, twice)
    weights, answers = levels(coded, words, known, buckets)
    parts = max(buckets, -(-weights.count() // max(1, HELD_RUNS)))
    sums = []
    for turn in range(TURNS):
        own = materialised(run_weights(answered(coded, answers), weights, parts, turn), "answers")
        sums.append(materialised(run_sums(answered(coded, [*answers, own], (WEIGHT,)), parts, turn), "sums"))
        _discard([own])
    _discard([weights, *answers[1:]])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for piece in _each(batches):
            n = piece.value(1)
            runs = piece.value(WEIGHT, np.float64).reshape(TURNS, -1).sum(0)
            begin = np.cumsum(piece.size) - piece.size
            sums = [np.add.reduceat(v, begin) for v in (
                (n > 0)[piece.seq].astype(np.int64), known.base(n)[piece.seq], known.root(n)[piece.seq])]
            sums[2] = sums[2] + runs
            yield pa.RecordBatch.from_arrays(
                [piece.doc_id, piece.train, pa.array(piece.size), *map(pa.array, sums)],
                ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    scored = answered(coded, [words, *sums], (1, WEIGHT)).mapInArrow(
        run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
