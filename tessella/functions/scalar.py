"""Built-in functions of the query language on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.folding import fold


def to_int(s: Column) -> Column:
    """Leading integer of a string as C's atoi reads it: 0 if there is none, null for null."""
    digits = F.regexp_extract(s, r"\A[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    return F.when(s.isNotNull(), F.coalesce(digits.try_cast("long"), F.lit(0).cast("long")))


def distance(a: Column, b: Column) -> Column:
    """b - a; an unset label counts as -1."""
    return F.coalesce(b, F.lit(-1)) - F.coalesce(a, F.lit(-1))


def distabs(a: Column, b: Column) -> Column:
    return F.abs(distance(a, b))


def prefix(a: Column, b: Column) -> Column:
    """Longest common prefix; whole characters, where byte prefixes would cut one in half."""
    n = F.least(F.length(a), F.length(b))
    common = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda k, i: F.when((k == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k),
    )
    return F.when(a.isNotNull() & b.isNotNull(), F.substr(a, F.lit(1), common))


def is_prefix(a: Column, b: Column) -> Column:
    return F.startswith(b, a).cast("long")


def minus(a: Column, b: Column) -> Column:
    """What remains of a after the common prefix with b."""
    return F.substr(a, F.length(prefix(a, b)) + 1)


def normalize(s: Column, flags: str) -> Column:
    return fold(s, flags.lstrip("%"))


def region_flags(cpos: Column, start: Column, end: Column) -> Column:
    """1 at a region's start, 2 at its end, 4 inside; null outside."""
    return F.when(start.isNotNull(), 4 + (cpos == start).cast("long") + 2 * (cpos == end).cast("long"))


def entity_decode(s: Column) -> Column:
    """The five XML entities; ampersands last."""
    # The entities and their characters.
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(c))
    return s


def zap_controls(s: Column) -> Column:
    return F.regexp_replace(s, "[\\x00-\\x1f]", "?")


def valid_text(s: Column) -> Column:
    """Whether the bytes of a string are UTF-8; null for null."""
    return F.is_valid_utf8(s)


def repair_text(s: Column) -> Column:
    """Bytes that aren't UTF-8 as U+FFFD."""
    return F.make_valid_utf8(s)
