"""Algebra and pruning of interval sets. All work by corpus; an element is its (match, matchend).

Pruning is windowed over fixed blocks of positions.
No window is partitioned by corpus alone, so a corpus that holds most rows is cut too.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.model import result

KEY = ["corpus", "match", "matchend"]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of either, once; the anchors of ``a`` where both have it. Sort order is dropped."""
    both = result(a).withColumn("_o", F.lit(0)).unionByName(result(b).withColumn("_o", F.lit(1)))
    first = both.groupBy(*KEY).agg(F.min(F.struct("_o", "target", "keyword")).alias("_r"))
    return result(first.select(*KEY, "_r.target", "_r.keyword"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of ``a`` that ``b`` has, with the anchors of ``a``."""
    return result(a).drop("sort_rank").join(b.select(*KEY).distinct(), KEY, "left_semi").transform(result)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of ``a`` that ``b`` lacks."""
    return result(a).drop("sort_rank").join(b.select(*KEY).distinct(), KEY, "left_anti").transform(result)


def unique(a: DataFrame) -> DataFrame:
    """One row per element: the one with the least anchors, for a defined choice."""
    return result(a).groupBy(*KEY).agg(F.min(F.struct("target", "keyword", "sort_rank")).alias("_r")).select(*KEY, "_r.*").transform(result)


BLOCK = 1 << 16


def _blocks(a: DataFrame) -> DataFrame:
    """Rows repeated for each block of positions they touch, with ``_block``; ``_own`` in the block of their start."""
    b = F.explode(F.sequence(F.floor(F.col("match") / BLOCK), F.floor(F.col("matchend") / BLOCK)))
    return a.withColumn("_block", b).withColumn("_own", F.col("_block") == F.floor(F.col("match") / BLOCK))


def maximal(a: DataFrame) -> DataFrame:
    """Elements that no other element contains. A containing element touches the block of the start, so blocks suffice."""
    rows = _blocks(unique(a))
    w = Window.partitionBy("corpus", "_block").orderBy("match", F.desc("matchend")).rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.withColumn("_m", F.max("matchend").over(w)).filter("_own and (_m is null or _m < matchend)")
    return result(kept)


def minimal(a: DataFrame) -> DataFrame:
    """Elements that contain no other; the shortest of those with one start.

    A contained element may lie in a later block than the start, so the decision is
    made in every block an element touches: contained ones are looked for among
    those that start in the block, and one hit anywhere drops the element.
    """
    rows = _blocks(unique(a))
    # from the right: the least end among rows that start later, or at the same place and end earlier
    w = Window.partitionBy("corpus", "_block").orderBy(F.desc("match"), "matchend").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.min(F.when(F.col("_own"), F.col("matchend"))).over(w)
    hit = rows.withColumn("_in", inner).withColumn("_bad", F.coalesce(F.col("_in") <= F.col("matchend"), F.lit(False)))
    judged = hit.groupBy(*KEY).agg(F.max("_bad").alias("_bad"), F.first("target").alias("target"), F.first("keyword").alias("keyword"), F.first("sort_rank").alias("sort_rank"))
    return result(judged.filter(~F.col("_bad")))


def left_maximal(a: DataFrame) -> DataFrame:
    """The shortest per start, then per end the earliest start."""
    first = unique(a).groupBy("corpus", "match").agg(F.min(F.struct("matchend", "target", "keyword")).alias("_r")).select("corpus", "match", "_r.*")
    last = first.groupBy("corpus", "matchend").agg(F.min(F.struct("match", "target", "keyword")).alias("_r")).select("corpus", "matchend", "_r.*")
    return result(last)


def clusters(a: DataFrame) -> DataFrame:
    """``_cluster``: the start of the run of overlapping elements that holds the row.

    A cluster begins where no earlier element reaches. Within a block that is a
    running maximum; what reaches in from earlier blocks is carried by a table of one row
    per block and corpus.
    """
    rows = a.withColumn("_block", F.floor(F.col("match") / BLOCK))
    per = rows.groupBy("corpus", "_block").agg(F.max("matchend").alias("_end"))
    carried = per.withColumn("_carry", F.max("_end").over(Window.partitionBy("corpus").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    w = Window.partitionBy("corpus", "_block").orderBy("match", "matchend")
    before = F.max("matchend").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = rows.join(carried, ["corpus", "_block"]).withColumn("_new", F.coalesce(F.col("match") > F.greatest(before, F.col("_carry")), F.lit(True)))
    begun = begun.withColumn("_start", F.when(F.col("_new"), F.col("match")))
    local = begun.withColumn("_c", F.last("_start", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tails = begun.groupBy("corpus", "_block").agg(F.max("_start").alias("_s"))
    open_ = tails.withColumn("_open", F.last("_s", True).over(Window.partitionBy("corpus").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
    return local.join(open_, ["corpus", "_block"]).withColumn("_cluster", F.coalesce("_c", "_open")).drop("_block", "_carry", "_new", "_start", "_c", "_open")


def non_overlapping(a: DataFrame) -> DataFrame:
    """Greedy from the left: an element that starts at or before the end of the last one kept is dropped.

    The corpus is cut into blocks by start. What a block keeps depends on the end that
    the blocks before it carry in, so each block says for every end that may come in which end goes out
    (``_outcomes``: no more rows than elements that begin under an end from before, and few of them, as greedy chains meet);
    these small tables are chained by corpus, and every block is then folded by itself.
    """
    rows = unique(a).withColumn("_block", F.floor(F.col("match") / BLOCK))
    ends = rows.groupBy("corpus", "_block").agg(F.max("matchend").alias("_end"))
    reach = ends.select("corpus", "_block", F.coalesce(F.max("_end").over(Window.partitionBy("corpus").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1).cast("long")).alias("_reach"))
    key = ["corpus", "_block"]
    spans = rows.select(*key, "match", "matchend").join(reach, key)
    chained = spans.groupBy(*key).applyInArrow(lambda t: _outcomes(t), "corpus string, _block bigint, upto bigint, out bigint").groupBy("corpus").applyInArrow(lambda t: _chain(t), "corpus string, _block bigint, _carry bigint")
    kept = rows.select(*key, "match", "matchend").join(chained, key).groupBy(*key).applyInArrow(lambda t: _kept(t), "corpus string, match bigint, matchend bigint")
    return result(rows.drop("_block").join(kept, KEY))


def _greedy(starts: list[int], ends: list[int]) -> list[int]:
    """For each element, the next one that is kept after it; len(starts) if there is none."""
    return np.searchsorted(np.array(starts), np.array(ends), "right").tolist()


def _outcomes(table: pa.Table) -> pa.Table:
    """(upto, out): an end carried in that is at most upto, and above the one of the row before, goes out as ``out`` (null: as it came)."""
    table = table.sort_by([("match", "ascending"), ("matchend", "ascending")])
    starts, ends = table["match"].to_pylist(), table["matchend"].to_pylist()
    after, out = _greedy(starts, ends), list(ends)
    for i in range(len(starts) - 1, -1, -1):
        if after[i] < len(starts):
            out[i] = out[after[i]]
    reach = table["_reach"][0].as_py()
    upto, outs = [], []
    # the first of those that start alike is entered; up to its start less one, the element is
    for i, s in enumerate(starts):
        if i and starts[i - 1] == s:
            continue
        upto.append(s - 1)
        outs.append(out[i])
        if s > reach:
            break
    else:
        upto.append(reach)
        outs.append(None)
    # chains soon meet: of thresholds with one outcome the last says it all
    last = [k for k in range(len(upto)) if k + 1 == len(upto) or outs[k + 1] != outs[k]]
    upto, outs, n = [upto[k] for k in last], [outs[k] for k in last], len(last)
    return pa.table([pa.array([table["corpus"][0].as_py()] * n, pa.string()), pa.array([table["_block"][0].as_py()] * n, pa.int64()), pa.array(upto, pa.int64()), pa.array(outs, pa.int64())], names=["corpus", "_block", "upto", "out"])


def _chain(table: pa.Table) -> pa.Table:
    table = table.sort_by([("_block", "ascending"), ("upto", "ascending")])
    blocks, carries, end = [], [], -1
    done = True
    for b, upto, out in zip(*(table[c].to_pylist() for c in ("_block", "upto", "out")), strict=True):
        if not blocks or blocks[-1] != b:
            blocks.append(b)
            carries.append(end)
            done = False
        if not done and carries[-1] <= upto:
            end, done = (end if out is None else out), True
    return pa.table([pa.array([table["corpus"][0].as_py()] * len(blocks), pa.string()), pa.array(blocks, pa.int64()), pa.array(carries, pa.int64())], names=["corpus", "_block", "_carry"])


def _kept(table: pa.Table) -> pa.Table:
    table = table.sort_by([("match", "ascending"), ("matchend", "ascending")])
    starts = table["match"].to_pylist()
    after = _greedy(starts, table["matchend"].to_pylist())
    at, i = [], bisect_right(starts, table["_carry"][0].as_py())
    while i < len(starts):
        at.append(i)
        i = after[i]
    return table.select(["corpus", "match", "matchend"]).take(pa.array(at, pa.int64()))


def prune(a: DataFrame, strategy: str) -> DataFrame:
    """What a matching strategy leaves of the raw matches."""
    return {"traditional": unique, "standard": left_maximal, "shortest": minimal, "longest": maximal}[strategy](a)


def containing(parents: DataFrame, inner: DataFrame) -> DataFrame:
    """Parents that hold at least one of the inner intervals (keep)."""
    from tessella.operators.ranges import point_in_interval

    p = parents.select(F.col("corpus"), F.col("match").alias("_s"), F.col("matchend").alias("_e"))
    hit = point_in_interval(inner.select("corpus", "match", "matchend"), "match", p, "_s", "_e").filter(F.col("matchend") <= F.col("_e"))
    return result(parents).join(hit.select("corpus", F.col("_s").alias("match"), F.col("_e").alias("matchend")).distinct(), KEY, "left_semi").transform(result)


def complement(tokens: DataFrame, a: DataFrame) -> DataFrame:
    """All single positions of the corpora that ``a`` lacks; a longer interval among its rows is an error when the result is computed."""
    single = F.when(F.col("match") == F.col("matchend"), F.col("match")).otherwise(F.raise_error(F.lit("the complement is defined for single positions only")).cast("long"))
    a = a.withColumn("match", single)
    all_ = tokens.select("corpus", F.col("cpos").alias("match"), F.col("cpos").alias("matchend"))
    return difference(all_, a)
