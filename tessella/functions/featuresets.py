"""Feature sets: ``|a|b|`` strings, sorted bytewise; ``|`` is the empty set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _join(elements: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(elements, lambda x: F.concat(x, F.lit("|"))), ""))


def _elements(s: Column) -> Column:
    return F.filter(F.split(s, "\\|"), lambda x: x != "")


def is_set(s: Column) -> Column:
    return (s == "|") | (s.startswith("|") & s.endswith("|") & ~s.contains("||") & (F.length(s) > 2))


def make_set(s: Column, split: bool = False) -> Column:
    """Sorted, duplicates kept; null for a null or malformed value. ``split`` takes blank-separated elements."""
    if split:
        return F.when(s.contains("|"), None).otherwise(_join(F.array_sort(F.filter(F.split(s, "[ \\t\\r\\n]+"), lambda x: x != ""))))
    return F.when(is_set(s), _join(F.array_sort(_elements(s))))


def set_size(s: Column) -> Column:
    """Number of elements; -1 for a malformed value, null for null."""
    return F.when(is_set(s), F.size(_elements(s)).cast("long")).when(s.isNotNull(), F.lit(-1).cast("long"))


def set_intersection(a: Column, b: Column) -> Column:
    """Elements of both, as often as in the one that has fewer of them; null if either is malformed."""
    ea, eb = _elements(a), _elements(b)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    both = F.flatten(F.transform(F.array_distinct(F.array_intersect(ea, eb)), lambda x: F.array_repeat(x, F.least(count(ea, x), count(eb, x)))))
    return F.when(is_set(a) & is_set(b), _join(F.array_sort(both)))


def _malformed(function: str, kind: str) -> Column:
    return F.raise_error(F.lit(f"{function}() of a malformed or undefined set")).cast(kind)


def unify(a: Column, b: Column) -> Column:
    """Intersection; an undefined first argument gives the second as it is. Malformed sets, and an undefined second one, are errors."""
    good = b.isNotNull() & (a.isNull() | (is_set(a) & is_set(b)))
    return F.when(F.coalesce(good, F.lit(False)), F.when(a.isNull(), b).otherwise(set_intersection(a, b))).otherwise(_malformed("unify", "string"))


def ambiguity(s: Column) -> Column:
    """Cardinality; 0 for an undefined value; a malformed one is an error."""
    return F.when(s.isNull(), F.lit(0).cast("long")).when(is_set(s), set_size(s)).otherwise(_malformed("ambiguity", "bigint"))
