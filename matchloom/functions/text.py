"""Text normalisation as Column expressions."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import fixed_values as fv
from matchloom.functions.numeric import let

# ---------------------------------------------------------------- fixed values
BLANKS = (
    r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}]+"
)
PICTOGRAPHS = (
    r"[\p{So}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{FE00}-\x{FE0F}\x{1F3FB}-\x{1F3FF}"
    r"\x{1F1E6}-\x{1F1FF}]"
)
TOKEN = r"([a-z0-9+#.]+)"
JS_SUFFIX = r"(?:\.js|\s+js|-js|js)$"
WELDED_LEVEL = r"(?U)\b(sde|swe|mts|sse)[-\s]?([1-4]|i{1,3}|iv)\b"
# ------------------------------------------------------------ end fixed values

# Letters that compatibility normalisation leaves alone; anything else goes to Arrow.
_NEEDS_UNICODE = r"[^\x00-\x7F\x{C0}-\x{FF}]"


#: Code points that are no characters, to stand between texts.
_DIVIDERS = [chr(c) for c in (0x10FFFF, 0x10FFFE, 0xFFFFF, 0xFFFFE, *range(0xFDD0, 0xFDF0))]


@lru_cache(maxsize=1)
def _patterns() -> tuple[str, str]:
    """Expressions for runs of what is taken out (symbols and marks of pictographs), and of white space.

    They are made from all code points, so the driver makes them once and functions carry them.
    """
    def runs(has) -> str:
        codes = [c for c in range(sys.maxunicode + 1) if has(chr(c))]
        firsts = [c for k, c in enumerate(codes) if k == 0 or codes[k - 1] != c - 1]
        lasts = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(firsts, lasts))

    marks = "\u200b-\u200f\u2060\ufeff\ufe00-\ufe0f\U0001f3fb-\U0001f3ff\U0001f1e6-\U0001f1ff"
    return f"[{marks}{runs(lambda c: unicodedata.category(c) == 'So')}]+", f"[{runs(str.isspace)}]+"


def fold_texts(texts: list[str], patterns: tuple[str, str] | None = None) -> list[str]:
    """Texts compatibility-normalised, without pictographs, single-spaced and case-folded.

    All texts are folded as one, with a code point between them that no text has:
    it takes part in no composition, so none reaches over it.
    """
    gone, blank = map(re.compile, patterns or _patterns())
    whole = "".join(texts)
    divider = next((d for d in _DIVIDERS if d not in whole), None)
    if divider is None:
        return [fold_texts([t], patterns)[0] for t in texts] if len(texts) > 1 else [_folded(whole, gone, blank).strip(" ")]
    text = _folded(divider.join(texts), gone, blank)
    return re.sub(f" ?{divider} ?", divider, text).strip(" ").split(divider) if texts else []


def _folded(text: str, gone: re.Pattern, blank: re.Pattern) -> str:
    return blank.sub(" ", gone.sub("", unicodedata.normalize("NFKC", text))).casefold()


@lru_cache(maxsize=1)
def _fold_unicode():
    """Arrow UDF for text with compatibility characters."""
    patterns = _patterns()

    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = texts.astype(object)
        out[known] = fold_texts(texts[known].tolist(), patterns)
        return out

    return F.pandas_udf(run, T.StringType())


@lru_cache(maxsize=1)
def _compat_json():
    """Arrow UDF that compatibility-normalises the strings inside a JSON document."""
    def fold(doc: str) -> str:
        # These three would turn into JSON syntax, so they are escaped first.
        doc = doc.replace("\uff02", '\\"').replace("\uff3c", "\\\\").replace("\ufe68", "\\\\")
        return unicodedata.normalize("NFKC", doc)

    def run(docs: pd.Series) -> pd.Series:
        return docs.map(fold, na_action="ignore")

    return F.pandas_udf(run, T.StringType())


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, PICTOGRAPHS, "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def _plain(c: Column) -> Column:
    low = F.lower(squeeze(strip_emoji(c)))
    return F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "ς", "σ")


def norm_plain(c: Column) -> Column:
    """:func:`norm_text` for text known to hold no compatibility characters."""
    return F.coalesce(_plain(c), F.lit(""))


def norm_text(c: Column) -> Column:
    """Compatibility-normalised, emoji-free, single-spaced, case-folded; null is ''.

    Only rows holding characters beyond Latin-1 letters travel to Python; for
    all others the UDF argument is null and the JVM expression decides.
    """
    unusual = F.when(c.rlike(_NEEDS_UNICODE), c)
    return F.coalesce(_fold_unicode()(unusual), _plain(c), F.lit(""))


def norm_nested(value: Column, ddl: str) -> Column:
    """``value`` with every string in it compatibility-normalised (for nested lists)."""
    doc = F.to_json(value)
    unusual = F.when(doc.rlike(_NEEDS_UNICODE), doc)
    return F.coalesce(F.from_json(_compat_json()(unusual), ddl), value)


def norm_company(normed: Column) -> Column:
    """Company key from already normalised text."""
    suffixes = "|".join(fv.LEGAL_SUFFIXES)
    text = F.replace(normed, F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, r"(?U)[^\w\s]", " ")
    text = F.regexp_replace(text, rf"(?U)\b({suffixes})\b", " ")
    return squeeze(text)


def literal_map(pairs: dict) -> Column:
    """A constant map, folded once by the optimizer."""
    kind = "double" if all(isinstance(v, (int, float)) for v in pairs.values()) else "string"
    return F.from_json(F.lit(json.dumps(pairs)), f"map<string, {kind}>")


def literal_list(items: list[str]) -> Column:
    """A constant list of texts."""
    return F.from_json(F.lit(json.dumps(items)), "array<string>")


def norm_skill(normed: Column, aliases: Column | None = None) -> Column:
    """Canonical skill from already normalised text; ``aliases`` is a map column."""
    text = F.regexp_replace(normed, r"(?U)^[^\w]+|[^\w]+$", "")
    text = squeeze(F.replace(text, F.lit("_"), F.lit(" ")))

    def resolved(t: Column) -> Column:
        cut = F.trim(F.regexp_replace(t, JS_SUFFIX, ""))
        bare = F.coalesce(F.nullif(cut, F.lit("")), t)
        if aliases is None:
            return bare
        return let(bare, lambda b: F.coalesce(
            F.try_element_at(aliases, t), F.try_element_at(aliases, b), b))

    return let(text, resolved)


def norm_title(normed: Column) -> Column:
    """``struct(core, prefixes)`` from already normalised text."""
    words = "|".join(re.escape(word) for word in fv.LEVEL_PREFIXES)
    marks = "|".join(fv.LEVEL_SUFFIXES)
    head = F.regexp_extract(normed, r"^([^|]*)", 1)
    head = F.regexp_replace(head, r"(?s)(\s+@\s+|\s+@|@\s+|\s+at\s+).*$", "")
    text = F.replace(head, F.lit("&"), F.lit(" and "))
    text = squeeze(F.regexp_replace(text, r"(?U)[^\w+#/. -]", " "))
    text = F.regexp_replace(text, r"^[ .-]+|[ .-]+$", "")
    text = F.regexp_replace(text, WELDED_LEVEL, "$1 $2")

    def items(part: Column) -> Column:
        return F.filter(F.split(F.trim(part), " "), lambda w: w != "")

    def parts(t: Column, front: Column, rest: Column, back: Column) -> Column:
        core = F.trim(F.substring(rest, F.lit(1), F.length(rest) - F.length(back)))
        return F.struct(
            F.coalesce(F.nullif(core, F.lit("")), F.trim(t)).alias("core"),
            F.concat(items(front), F.reverse(items(back))).alias("prefixes"))

    return let(text, lambda t: let(
        F.regexp_extract(t, rf"^((?:(?:{words})(?: |$))*)", 1), lambda front: let(
            F.substring(t, F.length(front) + 1, F.length(t)), lambda rest: parts(
                t, front, rest, F.regexp_extract(rest, rf"((?:(?:^| )(?:{marks}))*)$", 1)))))


def tokens(normed: Column) -> Column:
    return F.regexp_extract_all(normed, F.lit(TOKEN), 1)


def phrase_pattern(phrase: str) -> str:
    """Regular expression for ``phrase`` at word boundaries."""
    return rf"(?U)(?<!\w){re.escape(phrase)}(?!\w)"


def has_phrase(text: Column, phrase: str) -> Column:
    return text.contains(phrase) & text.rlike(phrase_pattern(phrase))


def has_any_phrase(text: Column, phrases: list[str]) -> Column:
    either = "|".join(re.escape(phrase) for phrase in phrases)
    return text.rlike(rf"(?U)(?<!\w)(?:{either})(?!\w)")


def label_slug(normed: Column) -> Column:
    slug = F.regexp_replace(normed, r"[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(slug, r"^_+|_+$", ""), 1, 48)


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def text_fallback(full: Column, parts: list[Column]) -> Column:
    """``full`` if present, else the non-empty parts joined by a spaced bar."""
    joined = F.array_join(F.filter(F.array(*[blank_if_null(p) for p in parts]),
                                   lambda part: part != ""), " | ")
    return F.when(blank_if_null(full) != "", full).otherwise(joined)
