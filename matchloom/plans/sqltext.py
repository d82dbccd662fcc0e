"""Small SQL text builders for the oracle side."""

from __future__ import annotations

EMOJI = (
    r"[\p{So}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{FE00}-\x{FE0F}\x{1F3FB}-\x{1F3FF}"
    r"\x{1F1E6}-\x{1F1FF}]"
)


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) if isinstance(i, (str, type(None))) else str(i) for i in items) + "]"


def pick(items, index: str) -> str:
    return f"({sql_list(items)})[1 + CAST({index} AS BIGINT)]"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, (str, type(None))) else str(v)
                                     for v in row) + ")" for row in rows)


def norm(x: str) -> str:
    return (f"replace(trim(regexp_replace(lower(regexp_replace(coalesce({x}, ''), '{EMOJI}', '', "
            f"'g')), '\\s+', ' ', 'g')), 'ß', 'ss')")


def months(a: str, b: str) -> str:
    return (f"greatest(0, (year({b}) - year({a})) * 12 + month({b}) - month({a}) - "
            f"CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)")


def rx(c: str, digits: int) -> str:
    """Correctly rounded value of a double column, half to even on its exact value."""
    s = f"{10**digits}::DOUBLE"
    w = "134217729::DOUBLE"
    high = f"({c} * {w} - ({c} * {w} - {c}))"
    err = f"(({high} * {s} - {c} * {s}) + ({c} - {high}) * {s})"
    y = f"({c} * {s})"
    return (f"(CASE WHEN {y} - floor({y}) = 0.5 THEN CASE WHEN {err} > 0 THEN floor({y}) + 1 "
            f"WHEN {err} < 0 THEN floor({y}) ELSE 2 * round({y} / 2) END "
            f"ELSE round({y}) END / {s})")


def boundary(needle: str) -> str:
    """Regular expression for ``needle`` at ASCII word boundaries."""
    body = "".join("\\" + ch if ch in ".+*?()[]{}|^$" else ch for ch in needle)
    return f"(^|[^\\w]){body}($|[^\\w])"


def phrase(text: str, needle: str) -> str:
    """``needle`` (a column with a sibling ``rx``) inside ``text`` at word boundaries."""
    rx = needle.rsplit(".", 1)[0] + ".rx" if "." in needle else "rx"
    return f"(CASE WHEN contains({text}, {needle}) THEN regexp_matches({text}, {rx}) ELSE FALSE END)"


def any_phrase(text: str, phrases) -> str:
    import re
    either = "|".join(re.escape(p).replace("\\ ", " ").replace("\\&", "&") for p in phrases)
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({text}, {q(f'(^|{edge})({either})($|{edge})')})"


def joined(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, '{sep}')"
