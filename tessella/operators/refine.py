"""Refinement of results: anchors, expansion, subsets, deletion, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.model import Corpus, result
from tessella.operators import intervals
from tessella.operators.ranges import point_in_interval
from tessella.operators.skew import running_sum
from tessella.plans.predicates import Compiler


def _lookup(corpus: Corpus, rows: DataFrame, at: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with token columns of the position in ``at``, under new names; null where there is no token."""
    t = corpus.tokens.select(F.col("corpus").alias("_lc"), F.col("cpos").alias("_lp"), *[F.col(c).alias(n) for c, n in columns.items()])
    return rows.join(t, (F.col("corpus") == F.col("_lc")) & (F.col(at) == F.col("_lp")), "left").drop("_lc", "_lp")


def _low(n: int) -> Column:
    """Number of the region n - 1 before ``_a``, the first at least; null outside regions."""
    return F.when(F.col("_a").isNotNull(), F.greatest(F.col("_a") - (n - 1), F.col("_first")))


def _high(n: int) -> Column:
    return F.when(F.col("_z").isNotNull(), F.least(F.col("_z") + (n - 1), F.col("_last")))


def expand(corpus: Corpus, a: DataFrame, n: int = 1, satt: str | None = None, side: str = "both", both_needed: bool = False) -> DataFrame:
    """Widen by n words, or so as to cover the n-th region from that of either edge (1: its own).

    A row whose edge lies in no region stays as it is on that side; with
    ``both_needed`` (the implicit form) it stays on both. Equal rows are made one.
    """
    rows = result(a).drop("sort_rank")
    if satt is None:
        size = corpus.size()
        rows = rows.join(size, "corpus")
        lo, hi = F.greatest(F.col("match") - n, F.lit(0)), F.least(F.col("matchend") + n, F.col("size") - 1)
    else:
        rows = _lookup(corpus, rows, "match", {f"{satt}_id": "_a"})
        rows = _lookup(corpus, rows, "matchend", {f"{satt}_id": "_z"})
        regions = corpus.regions.filter(F.col("satt") == satt)
        edge = regions.groupBy("corpus").agg(F.min("struc").alias("_first"), F.max("struc").alias("_last"))
        rows = rows.join(edge, "corpus", "left")
        lows = regions.select("corpus", F.col("struc").alias("_ls"), F.col("start").alias("_lo"))
        highs = regions.select("corpus", F.col("struc").alias("_hs"), F.col("end").alias("_hi"))
        rows = rows.withColumn("_ls", _low(n)).withColumn("_hs", _high(n))
        rows = rows.join(lows, ["corpus", "_ls"], "left").join(highs, ["corpus", "_hs"], "left")
        lo, hi = F.coalesce("_lo", "match"), F.coalesce("_hi", "matchend")
        if both_needed:
            ok = F.col("_lo").isNotNull() & F.col("_hi").isNotNull()
            lo, hi = F.when(ok, lo).otherwise(F.col("match")), F.when(ok, hi).otherwise(F.col("matchend"))
    lo = lo if side in ("both", "left") else F.col("match")
    hi = hi if side in ("both", "right") else F.col("matchend")
    return intervals.unique(result(rows.withColumns({"match": lo, "matchend": hi})))


def subset(corpus: Corpus, a: DataFrame, anchor: str, test: object, variables: dict | None = None) -> DataFrame:
    """Rows whose anchor's token passes the test; rows without the anchor go."""
    hits = corpus.tokens.filter(Compiler(corpus.patts, corpus.satts, variables, functions=corpus.functions).test(test)).select(F.col("corpus").alias("_c"), F.col("cpos").alias("_p"))
    return result(a.join(hits, (F.col("corpus") == F.col("_c")) & (F.col(anchor) == F.col("_p")), "left_semi"))


def set_anchor(a: DataFrame, to: str, source: str | None) -> DataFrame:
    """Copy an anchor, or erase one (source None). A match edge keeps its value where the source is null, and stays on its side of the other."""
    if source is None:
        if to in ("match", "matchend"):
            raise ValueError("match and matchend can't be erased")
        return a.withColumn(to, F.lit(None).cast("long"))
    if to in ("target", "keyword"):
        return a.withColumn(to, F.col(source))
    v = F.coalesce(F.col(source), F.col(to))
    moved = a.withColumn(to, F.least(v, F.col("matchend")) if to == "match" else F.greatest(v, F.col("match")))
    return moved.withColumn("sort_rank", F.lit(None).cast("long"))


def set_anchor_search(corpus: Corpus, a: DataFrame, to: str, which: str, test: object, n: int, satt: str | None = None, side: str = "both", base: str = "match", inclusive: bool = False, variables: dict | None = None) -> DataFrame:
    """Set an anchor to the leftmost, rightmost, nearest or farthest token that passes ``test`` around ``base``.

    The window is n words, or n - 1 regions, to either side of the base. Exclusive
    searches skip the whole match if the base is ``match``, else the base's token;
    distances count from the base. At equal distance the left one wins. Not found:
    null, or unchanged for match and matchend. Rows with a null base find nothing.
    """
    lo_base = F.col(base)
    whole = base == "match" and not inclusive
    hi_base = F.col("matchend") if whole else F.col(base)
    rows = result(a).withColumn("_row", F.xxhash64("corpus", "match", "matchend", "target", "keyword", "sort_rank"))
    if satt is None:
        windows = rows.withColumns({"_lo": lo_base - n, "_hi": hi_base + n})
    else:
        regions = corpus.regions.filter(F.col("satt") == satt)
        windows = _lookup(corpus, rows.withColumn("_hb", hi_base), base, {f"{satt}_id": "_a"})
        windows = _lookup(corpus, windows, "_hb", {f"{satt}_id": "_z"})
        ends = regions.groupBy("corpus").agg(F.min("struc").alias("_first"), F.max("struc").alias("_last"))
        windows = windows.join(ends, "corpus", "left").withColumns({"_ls": _low(n), "_hs": _high(n)})
        windows = windows.join(regions.select("corpus", F.col("struc").alias("_ls"), F.col("start").alias("_lo")), ["corpus", "_ls"], "left")
        windows = windows.join(regions.select("corpus", F.col("struc").alias("_hs"), F.col("end").alias("_hi")), ["corpus", "_hs"], "left")
    hits = corpus.tokens.filter(Compiler(corpus.patts, corpus.satts, variables, functions=corpus.functions).test(test)).select("corpus", F.col("cpos").alias("_p"))
    spans = windows.filter("_lo <= _hi").select("corpus", F.col("_row").alias("_r"), F.greatest(F.col("_lo"), F.lit(0)).alias("_lo"), "_hi", lo_base.alias("_base"), hi_base.alias("_far")).distinct()
    found = point_in_interval(hits, "_p", spans, "_lo", "_hi")
    if not inclusive:
        found = found.filter((F.col("_p") < F.col("_base")) | (F.col("_p") > F.col("_far")))
    if side in ("left", "right"):
        found = found.filter(F.col("_p") < F.col("_base") if side == "left" else F.col("_p") > F.col("_base"))
    away = F.struct(F.abs(F.col("_p") - F.col("_base")), F.when(F.col("_p") <= F.col("_base"), 0).otherwise(1))
    far = F.struct(-F.abs(F.col("_p") - F.col("_base")), F.when(F.col("_p") <= F.col("_base"), 0).otherwise(1))
    best = {"leftmost": F.min("_p"), "rightmost": F.max("_p"), "nearest": F.min_by("_p", away), "farthest": F.min_by("_p", far)}[which]
    chosen = found.groupBy("corpus", "_r").agg(best.alias("_found"))
    out = rows.join(chosen.withColumnRenamed("corpus", "_c"), (F.col("corpus") == F.col("_c")) & (F.col("_row") == F.col("_r")), "left")
    if to in ("target", "keyword"):
        return result(out.withColumn(to, F.col("_found")))
    return result(set_anchor(out, to, "_found"))


FEW = 10_000


def first_rows(a: DataFrame, order: list[str], n: int, skip: int = 0) -> DataFrame:
    """Rows number ``skip`` (from 0) to n - 1 of each corpus in the order of distinct keys.

    Up to FEW rows a corpus come by a rank limit that Spark pushes below the shuffle, so no task
    sends or sorts more than that many; beyond, rows are numbered by prefix sums over range partitions.
    """
    if n <= FEW:
        rows = a.withColumn("_n", F.row_number().over(Window.partitionBy("corpus").orderBy(*order)))
    else:
        rows = running_sum(a.withColumn("_one", F.lit(1).cast("long")), ["corpus"], order, "_one", "_n").drop("_one")
    return rows.filter(F.col("_n") <= n).filter(F.col("_n") > skip).drop("_n")


def line_numbers(a: DataFrame, name: str = "line") -> DataFrame:
    """0-based line numbers per corpus in sort order, by distributed prefix sums: no task sees a whole corpus."""
    rows = result(a).withColumns({"_one": F.lit(1).cast("long"), "_s": F.coalesce("sort_rank", F.lit(0).cast("long")), "_e": -F.col("matchend"), "_t": F.coalesce("target", F.lit(-1).cast("long")), "_k": F.coalesce("keyword", F.lit(-1).cast("long"))})
    return running_sum(rows, ["corpus"], ["_s", "match", "_e", "_t", "_k"], "_one", name).withColumn(name, F.col(name) - 1).drop("_one", "_s", "_e", "_t", "_k")


def cut(a: DataFrame, n: int, m: int | None = None) -> DataFrame:
    """The first n rows, or rows n to m (0-based, inclusive), in sort order."""
    lo, hi = (0, n - 1) if m is None else (n, m)
    order = {"_s": F.coalesce("sort_rank", F.lit(0).cast("long")), "_e": -F.col("matchend"), "_t": F.coalesce("target", F.lit(-1).cast("long")), "_k": F.coalesce("keyword", F.lit(-1).cast("long"))}
    return result(first_rows(result(a).withColumns(order), ["_s", "match", "_e", "_t", "_k"], hi + 1, lo))


def delete_lines(a: DataFrame, n: int, m: int | None = None) -> DataFrame:
    """Without rows n to m by their number in corpus order; of equal rows only those with these numbers go."""
    m = n if m is None else m
    plain = result(a).withColumn("sort_rank", F.lit(None).cast("long"))
    return result(line_numbers(plain, "_n").filter(~F.col("_n").between(n, m)))


def delete_by_anchor(a: DataFrame, anchor: str, having: bool) -> DataFrame:
    """Without the rows that have (or lack) an anchor."""
    return result(a.filter(F.col(anchor).isNull() if having else F.col(anchor).isNotNull()))


def _sample_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "corpus", "match", "matchend")


def reduce(a: DataFrame, n: int | None = None, percent: int | None = None, seed: int = 0) -> DataFrame:
    """An exact-size random sample of rows per corpus, the same for the same seed; ``percent`` (1 to 99) rounds down."""
    rows = a.withColumn("_key", _sample_key(seed))
    if percent is not None:
        if not 1 <= percent <= 99:
            raise ValueError("percent must be 1 to 99")
        want = a.groupBy("corpus").agg(F.floor(F.count("*") * percent / 100).alias("_want"))
        lined = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), ["corpus"], ["_key", "match", "matchend"], "_one", "_n")
        return result(lined.join(want, "corpus").filter(F.col("_n") <= F.col("_want")))
    return result(first_rows(rows, ["_key", "match", "matchend"], n))


def reduce_maximal(a: DataFrame) -> DataFrame:
    return intervals.maximal(a)


def size(a: DataFrame, anchor: str | None = None) -> DataFrame:
    """(corpus, size): rows, or rows with an anchor."""
    return a.groupBy("corpus").agg((F.count("*") if anchor is None else F.count(anchor)).alias("size"))
