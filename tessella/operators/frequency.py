"""Frequency tables: n-gram scans, lexica, grouped anchors, counted spans, sorting."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.folding import fold
from tessella.functions.regex import matches
from tessella.functions.scalar import to_int
from tessella.model import Corpus, result
from tessella.operators.ranges import point_in_interval
from tessella.operators.skew import running_sum

# Fixed value: what a regular word is, letters and digits with inner hyphens, apostrophes and the like.
REGULAR = r"(?U)\A(?:[\p{L}\p{N}]+(?:[-'’.][\p{L}\p{N}]+)*)\z"


@dataclass(frozen=True)
class Key:
    """``[?]att[+n][=/re/cd]``; ``hidden`` constrains without being shown."""

    att: str
    offset: int = 0
    pattern: str | None = None
    flags: str = ""
    negated: bool = False
    hidden: bool = False

    @classmethod
    def parse(cls, text: str) -> Key:
        m = re.fullmatch(r"(\?)?([A-Za-z_][\w-]*?)(?:\+(\d+))?(?:(!?=)/(.*)/([cd]*))?", text, re.S)
        if not m:
            raise ValueError(f"not a key: {text!r}")
        return cls(m[2], int(m[3] or 0), m[5], "".join(sorted(set(m[6] or ""))), m[4] == "!=", bool(m[1]))


def scan(corpus: Corpus, keys: list[str], min_freq: int = 1, weight: str | None = None, regular: bool = False, start: int | None = None, end: int | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """N-gram counts: (corpus, key columns, freq) over all positions.

    A column is named ``<att>_<offset>``. A region key has its value; outside
    regions it shows "" and fails if constrained; ``?satt+n`` alone demands a
    region. ``weight`` sums an attribute's integers at offset 0 instead of counting;
    ``regular`` keeps tuples of regular words only. ``start``/``end`` (exclusive) and
    ``ranges`` (corpus, lo, hi, inclusive) confine whole tuples. Null values
    match nothing and give no tuple.

    Offsets are leads within blocks of positions whose tails repeat the next
    block's first tokens, so nothing is joined and no window holds a corpus; tuples are
    counted map-side before they are shuffled.
    """
    parsed = [Key.parse(k) for k in keys]
    width = max(k.offset for k in parsed)
    tokens = corpus.blocked(width) if width else corpus.tokens.withColumns({"_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    if start is not None:
        tokens = tokens.filter(F.col("cpos") >= start)
    if end is not None:
        tokens = tokens.filter(F.col("cpos") < end)
    if ranges is not None:
        r = ranges.select("corpus", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        tokens = point_in_interval(tokens, "cpos", r, "_lo", "_hi").withColumn("_range", F.col("_lo"))
    value = {}
    for k in parsed:
        if k.att in corpus.satts:
            value[k.att] = (F.coalesce(F.col(f"{k.att}_value"), F.lit("")), F.col(f"{k.att}_id").isNotNull())
        elif k.att in corpus.patts:
            value[k.att] = (F.col(k.att), F.lit(True))
        else:
            raise ValueError(f"unknown attribute {k.att}")
    cols = [v.alias(f"v_{a}") for a, (v, _) in value.items()] + [i.alias(f"i_{a}") for a, (_, i) in value.items()]
    if weight is not None:
        cols.append(to_int(F.col(weight)).alias("_w"))
    lo = ["_range"] if ranges is not None else []
    blocks = tokens.select("corpus", "cpos", "_block", "_own", *lo, *cols)
    w = Window.partitionBy("corpus", *lo, "_block").orderBy("cpos") if width else None

    def at(c: str, n: int) -> Column:
        return F.lead(c, n).over(w) if n else F.col(c)

    needed = {(c, k.offset) for k in parsed for c in (f"v_{k.att}", f"i_{k.att}")}
    moved = blocks.select(
        "corpus", "_own", *(["_w"] if weight else []), *[at(c, n).alias(f"{c}_{n}") for c, n in sorted(needed)],
        *([(F.lead("cpos", width).over(w) == F.col("cpos") + width).alias("_whole")] if width else []),
    )
    keep = F.col("_own") & (F.col("_whole") if width else F.lit(True))
    for k in parsed:
        v, inside = F.col(f"v_{k.att}_{k.offset}"), F.col(f"i_{k.att}_{k.offset}")
        keep = keep & v.isNotNull()
        if k.pattern is not None:
            hit = F.coalesce(matches(v, k.pattern, k.flags), F.lit(False))
            keep = keep & inside & (~hit if k.negated else hit)
        elif k.hidden:
            keep = keep & inside
        if regular and not k.hidden and k.att in corpus.patts:
            keep = keep & v.rlike(REGULAR)
    shown = [F.col(f"v_{k.att}_{k.offset}").alias(f"{k.att}_{k.offset}") for k in parsed if not k.hidden]
    total = F.sum("_w") if weight else F.count("*")
    counted = moved.filter(keep).groupBy("corpus", *shown).agg(total.alias("freq"))
    return counted.filter(F.col("freq") >= max(1, min_freq))


def lexicon_export(corpus: Corpus, att: str, pattern: str | None = None, flags: str = "", lookup: DataFrame | None = None, keep_unknown: bool = False) -> DataFrame:
    """(corpus, <att>, freq, len): all types, those matching a pattern, or those of a list (``keep_unknown``: freq 0).

    ``lookup`` has a column ``item``; with it the corpora of the result are those of the corpus.
    """
    types = corpus.tokens.filter(F.col(att).isNotNull()).groupBy("corpus", att).agg(F.count("*").alias("freq"))
    if pattern is not None:
        types = types.filter(matches(F.col(att), pattern, flags))
    if lookup is not None:
        items = lookup.select(F.col("item").alias(att)).distinct()
        if keep_unknown:
            names = corpus.tokens.agg(F.collect_set("corpus")).scalar()
            wanted = items.withColumn("corpus", F.explode(names))
            types = wanted.join(types, ["corpus", att], "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))
        else:
            types = types.join(items, att, "left_semi")
    return types.select("corpus", att, "freq", F.octet_length(att).cast("long").alias("len"))


def lexicon_sizes(corpus: Corpus, att: str) -> DataFrame:
    """(corpus, tokens, types)."""
    return corpus.tokens.groupBy("corpus").agg(F.count(att).alias("tokens"), F.count_distinct(att).alias("types"))


def _anchor_value(corpus: Corpus, a: DataFrame, anchor: str, offset: int, att: str, out: str, flags: str = "") -> DataFrame:
    c = f"{att}_value" if att in corpus.satts else att
    t = corpus.tokens.select(F.col("corpus").alias("_ac"), F.col("cpos").alias("_ap"), F.col(c).alias(out))
    rows = a.join(t, (F.col("corpus") == F.col("_ac")) & (F.col(anchor) + offset == F.col("_ap")), "left").drop("_ac", "_ap")
    return rows.withColumn(out, fold(F.col(out), flags)) if flags else rows


def group(corpus: Corpus, a: DataFrame, anchor: str, att: str, by: tuple[str, str] | None = None, cut: int = 1, offset: int = 0, by_offset: int = 0) -> DataFrame:
    """(corpus, source, target, freq): frequencies of an anchor's value, by that of another if given.

    The ``by`` item is the source, "(all)" without one. Undefined anchors and
    values outside regions count as "(none)". Rows of at least ``cut`` remain.
    """
    rows = _anchor_value(corpus, a, anchor, offset, att, "target_v")
    if by is not None:
        rows = _anchor_value(corpus, rows, by[0], by_offset, by[1], "source_v")
    none = lambda c: F.coalesce(F.col(c), F.lit("(none)"))
    source = F.lit("(all)") if by is None else none("source_v")
    return rows.groupBy("corpus", source.alias("source"), none("target_v").alias("target")).agg(F.count("*").alias("freq")).filter(F.col("freq") >= max(1, cut))


def grouped(corpus: Corpus, a: DataFrame, anchor: str, att: str, by: tuple[str, str], cut: int = 1) -> DataFrame:
    """``group by``: pairs with their source's total before the cut; ordered by total, source, freq, target."""
    pairs = group(corpus, a, anchor, att, by, 1)
    total = pairs.groupBy("corpus", "source").agg(F.sum("freq").alias("source_freq"))
    return pairs.join(total, ["corpus", "source"]).filter(F.col("freq") >= max(1, cut)).select("corpus", "source", "source_freq", "target", "freq")


@dataclass(frozen=True)
class Span:
    """From anchor + offset to anchor + offset; the whole match by default."""

    lo: str = "match"
    lo_offset: int = 0
    hi: str = "matchend"
    hi_offset: int = 0


def span_tokens(corpus: Corpus, a: DataFrame, att: str, span: Span = Span(), out: str = "toks", reverse: bool = False) -> DataFrame:  # noqa: B008
    """``a`` with the array of an attribute's values over a span, clamped to the corpus; right to left if ``reverse`` or if its ends are inverted.

    Spans are made distinct before they meet the tokens, and only (corpus, span) is joined back.
    """
    lo, hi = F.col(span.lo) + span.lo_offset, F.col(span.hi) + span.hi_offset
    rows = result(a).withColumns({"_lo": F.greatest(F.least(lo, hi), F.lit(0)), "_hi": F.greatest(lo, hi)})
    rows = rows.withColumns({"_lo": F.when((lo + hi).isNotNull(), F.col("_lo")), "_hi": F.when((lo + hi).isNotNull(), F.col("_hi"))})
    spans = rows.select("corpus", "_lo", "_hi").filter("_lo is not null").distinct()
    c = f"{att}_value" if att in corpus.satts else att
    hit = point_in_interval(corpus.tokens.select("corpus", "cpos", F.coalesce(c, F.lit("")).alias("_t")), "cpos", spans, "_lo", "_hi")
    toks = F.transform(F.array_sort(F.collect_list(F.struct("cpos", "_t"))), lambda x: x["_t"])
    joined = rows.join(hit.groupBy("corpus", "_lo", "_hi").agg(toks.alias(out)), ["corpus", "_lo", "_hi"], "left").drop("_lo", "_hi")
    joined = joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    if reverse:
        return joined.withColumn(out, F.transform(F.reverse(out), lambda x: F.reverse(x)))
    return joined.withColumn(out, F.when(lo > hi, F.reverse(out)).otherwise(F.col(out)))


def count(corpus: Corpus, a: DataFrame, att: str = "word", flags: str = "", span: Span = Span(), reverse: bool = False, cut: int = 1, descending: bool = False) -> DataFrame:  # noqa: B008
    """(corpus, text, size, first): equal token strings of the span, with the rank at which they start in sort order.

    text is folded as compared, and reversed if ``reverse``. Strings of at least ``cut`` rows remain.
    ``descending`` ranks from the end of the order.
    """
    rows = span_tokens(corpus, a, att, span, "toks", reverse)
    text = F.transform("toks", lambda x: fold(x, flags)) if flags else F.col("toks")
    sizes = rows.groupBy("corpus", text.alias("toks")).agg(F.count("*").alias("size"))
    ranked = running_sum(sizes, ["corpus"], ["toks"], "size", "_upto").withColumn("first", F.col("_upto") - F.col("size"))
    if descending:
        total = sizes.groupBy("corpus").agg(F.sum("size").alias("_all"))
        ranked = ranked.join(total, "corpus").withColumn("first", F.col("_all") - F.col("_upto"))
    return ranked.filter(F.col("size") >= max(1, cut)).select("corpus", F.array_join("toks", " ").alias("text"), "size", "first")


def sort(corpus: Corpus, a: DataFrame, att: str = "word", flags: str = "", span: Span = Span(), descending: bool = False, reverse: bool = False) -> DataFrame:  # noqa: B008
    """``a`` with sort_rank 0.. per corpus by the tokens of a span, bytewise.

    With flags, folded strings decide and plain ones break ties; then the shorter,
    then match order. Ranks come from a range sort with stitched prefix sums.
    """
    rows = span_tokens(corpus, a, att, span, "toks", reverse)
    keys = [F.transform("toks", lambda x: fold(x, flags)) if flags else F.col("toks"), F.col("toks")]
    packed = rows.withColumns({"_k": F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]), "_one": F.lit(1).cast("long")})
    sign = "desc" if descending else "asc"
    packed = packed.withColumns({"_t": F.coalesce("target", F.lit(-1).cast("long")), "_y": F.coalesce("keyword", F.lit(-1).cast("long"))})
    ranked = running_sum(packed.drop("toks", "sort_rank"), ["corpus"], ["_k", "match", "matchend", "_t", "_y"], "_one", "sort_rank")
    if sign == "desc":
        total = ranked.groupBy("corpus").agg(F.count("*").alias("_all"))
        ranked = ranked.join(total, "corpus").withColumn("sort_rank", F.col("_all") - F.col("sort_rank") + 1)
    return result(ranked.withColumn("sort_rank", F.col("sort_rank") - 1))


def randomize(a: DataFrame, seed: int) -> DataFrame:
    """A sort order by a key of (start, end, seed), the same for every superset of a row's result."""
    rows = a.drop("sort_rank").withColumns({"_key": F.xxhash64(F.lit(seed), "match", "matchend"), "_one": F.lit(1).cast("long"), "_e": -F.col("matchend")})
    return result(running_sum(rows, ["corpus"], ["_key", "match", "_e"], "_one", "sort_rank").withColumn("sort_rank", F.col("sort_rank") - 1))


def unsort(a: DataFrame) -> DataFrame:
    return a.withColumn("sort_rank", F.lit(None).cast("long"))
