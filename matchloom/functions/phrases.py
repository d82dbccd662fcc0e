"""Many phrases found in one pass over a text, by an Aho-Corasick automaton."""

from __future__ import annotations

import functools
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Words(dict):
    """Whether a character belongs to a word (letters, marks, decimal digits, connectors, joiners)."""

    def __missing__(self, char: str) -> bool:
        self[char] = regex.match(r"\w", char) is not None
        return self[char]


_WORDS = _Words()


@functools.lru_cache(maxsize=32)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """The automaton of some terms, made once per worker; an output is (place in ``terms``, length)."""
    made = ahocorasick.Automaton()
    for place, term in reversed(list(enumerate(terms))):
        if term:
            made.add_word(term, (place, len(term)))
    if not len(made):
        return None
    made.make_automaton()
    return made


def find(text: str, terms: ahocorasick.Automaton | None, whole_words: bool = True) -> list[int]:
    """Places of all terms of an automaton in ``text``, ascending, each once.

    With ``whole_words`` a term counts only where no word character stands before
    or behind it.  Of equal terms the first one is found; empty terms never are.
    """
    if terms is None:
        return []
    found = set()
    last = len(text) - 1
    for end, (place, length) in terms.iter(text):
        if place in found:
            continue
        start = end - length + 1
        if not whole_words or ((start == 0 or not _WORDS[text[start - 1]]) and (end == last or not _WORDS[text[end + 1]])):
            found.add(place)
    return sorted(found)


@functools.lru_cache(maxsize=32)
def _finder(terms: tuple[str, ...], whole_words: bool) -> Callable[[Column], Column]:
    def search(texts: pa.Array) -> pa.Array:
        made = automaton(terms)
        found = [find(t, made, whole_words) if t else [] for t in texts.to_pylist()]
        ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
        flat = np.fromiter((place for f in found for place in f), np.int32, int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    # Marked so that the optimizer leaves it a column of its own and does not copy it into lambdas.
    return F.arrow_udf(search, "array<int>").asNondeterministic()


def hits(text: Column, terms: list[str], whole_words: bool = True) -> Column:
    """``array<int>``: the places in ``terms`` of the terms that ``text`` holds, ascending.

    The cost follows the text and what is found in it, not the number of terms.
    Null and empty texts hold none.
    """
    return _finder(tuple(terms), whole_words)(text)
