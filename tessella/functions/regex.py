"""Regular expressions of the query language, as patterns of the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.folding import fold, fold_text

# Bracket classes and their Unicode properties.
CLASSES = {
    "alpha": "\\p{IsAlphabetic}", "digit": "\\p{IsDigit}", "alnum": "\\p{IsAlphabetic}\\p{IsDigit}", "upper": "\\p{IsUppercase}",
    "lower": "\\p{IsLowercase}", "punct": "\\p{IsPunctuation}", "space": "\\p{IsWhite_Space}", "blank": " \\t", "cntrl": "\\p{Cc}",
    "xdigit": "0-9A-Fa-f", "word": "\\w", "graph": "\\p{IsGraph}", "print": "\\p{IsPrint}",
}
META = set("[](){}.*+|?\\")


class RegexError(ValueError):
    pass


def is_literal(pattern: str) -> bool:
    return not META & set(pattern)


def translate(pattern: str) -> str:
    """Bracket classes as properties; constructs without a counterpart are refused."""
    for bad in ("(?R)", "\\K", "(?0)", "(?C"):
        if bad in pattern:
            raise RegexError(f"{bad} isn't supported")
    out = re.sub(r"\[:(\^?)(\w+):\]", lambda m: _named(m[1], m[2]), pattern)
    try:
        re.compile(re.sub(r"\\[pPX](\{\^?\w+\})?|\\[hHvVRQEGz]", "x", re.sub(r"([*+?}])\+", r"\1", out)))
    except re.error as e:
        raise RegexError(f"{pattern!r}: {e}") from None
    return out


def _named(negated: str, name: str) -> str:
    if name not in CLASSES:
        raise RegexError(f"unknown class [:{name}:]")
    return f"[^{CLASSES[name]}]" if negated else CLASSES[name]


def matches(value: Column, pattern: str, flags: str = "") -> Column:
    """Whole-value match; null for a null value.

    flags: ``c`` ignores case (Unicode, simple folding), ``d`` diacritics on both sides,
    ``l`` takes the pattern literally and overrides the others. A pattern
    without metacharacters and flags is an equality, which Parquet can prune by.
    """
    if "l" in flags or (not flags and is_literal(pattern)):
        return value == F.lit(pattern)
    java = translate(pattern)
    if "d" in flags:
        java, value = fold_text(java, "d"), fold(value, "d")
    return value.rlike(("(?iuU)" if "c" in flags else "(?U)") + f"\\A(?:{java})\\z")


def element_pattern(pattern: str) -> str:
    """``.`` must not cross the bars of a feature set."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append("[^|]" if c == "." and not inside else c)
        i += 1
    return "".join(out)


def set_contains(value: Column, pattern: str, flags: str = "") -> Column:
    return _set(value, f".*\\|(?:{element_pattern(pattern)})\\|.*", flags)


def set_matches(value: Column, pattern: str, flags: str = "") -> Column:
    return _set(value, f"\\|(?:(?:{element_pattern(pattern)})\\|)+", flags)


def _set(value: Column, pattern: str, flags: str) -> Column:
    if "l" in flags:
        raise RegexError("%l can't be used with contains or matches")
    return matches(value, pattern, flags or "") if not is_literal(pattern) else value.rlike(pattern)
