"""Case and diacritic folding inside generated code.

Spark has no Unicode normalisation; the single characters that folding changes
are found from Python's Unicode data when the module loads and go into one
``translate``, the few that become several characters into ``replace``.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_text(s: str, flags: str) -> str:
    """The definition: ``d`` decomposes, drops marks, composes; ``c`` is full case folding."""
    if "d" in flags:
        s = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M")))
    if "c" in flags:
        s = s.casefold()
    return s


@cache
def _changed(flag: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    one, to, many = [], [], []
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4 or unicodedata.category(c) == "Cn":
            continue
        f = fold_text(c, flag)
        if f == c:
            continue
        if len(f) == 1:
            one.append(c)
            to.append(f)
        elif f:
            many.append((c, f))
        else:
            one.append(c)  # last, as translate drops what has no counterpart
    dropped = [c for c in one if not fold_text(c, flag)]
    kept = [c for c in one if fold_text(c, flag)]
    return "".join(kept + dropped), "".join(to), tuple(many)


def _apply(value: Column, flag: str) -> Column:
    one, to, many = _changed(flag)
    if flag == "c":
        ascii_upper = "".join(map(chr, range(65, 91)))
        one, to = ascii_upper + one, ascii_upper.lower() + to
    out = F.call_function("translate", value, F.lit(one), F.lit(to))
    if many:
        expanded = out
        for c, f in many:
            expanded = F.replace(expanded, F.lit(c), F.lit(f))
        # nearly no value has such a character
        out = F.when(value.rlike("[" + re.escape("".join(c for c, _ in many)) + "]"), expanded).otherwise(out)
    return out


def fold(value: Column, flags: str) -> Column:
    if "d" in flags:
        value = _apply(value, "d")
    if "c" in flags:
        value = _apply(value, "c")
    return value
