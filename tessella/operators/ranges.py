"""Interval joins with an equi key, and denormalised region columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1024


def buckets(lo: Column, hi: Column, width: int = WIDTH) -> Column:
    """The buckets an inclusive interval touches; empty for an inverted one."""
    a, b = F.floor(lo / width), F.floor(hi / width)
    return F.when(lo <= hi, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def point_in_interval(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, how: str = "inner", width: int = WIDTH) -> DataFrame:
    """Points with the intervals that hold them, by corpus; an equi-join on (corpus, bucket) with the band as residual.

    Intervals are repeated for each bucket of ``width`` positions they touch, so
    short intervals are repeated once or twice. A point has one bucket, so no
    pair comes out twice. Both tables have a ``corpus`` column.
    """
    left = points.withColumn("_pb", F.floor(F.col(at) / width))
    right = intervals.withColumn("_pb", F.explode(buckets(F.col(lo), F.col(hi), width))).withColumnRenamed("corpus", "_pc").withColumnRenamed("_pb", "_prb")
    on = (F.col("corpus") == F.col("_pc")) & (F.col("_pb") == F.col("_prb")) & (F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))
    joined = left.join(right, on, how).drop("_pb")
    return joined if how in ("left_semi", "left_anti") else joined.drop("_prb", "_pc")


def flag_columns(tokens: DataFrame, regions: DataFrame, satts: list[str], size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Tokens by ``_block`` with ``<s>_id, <s>_start, <s>_end, <s>_value`` of the region of each s-attribute around them, or nulls.

    ``size`` is the number of positions of a block; it may hold ``before`` tokens of the block before and ``after`` of the next one.
    A region is sent to each block it touches; there, starts and tokens are put in order, and the last start seen
    is the region of a token if it reaches that far. So tokens are shuffled once, by (corpus, _block). Regions of one attribute don't
    overlap; where they do, the one that starts last counts, of those that start alike the least struc.
    """
    if not satts:
        return tokens
    own = [F.when(F.col("satt") == s, F.struct("struc", "start", "end", "value")).alias(f"_r_{s}") for s in satts]
    touched = F.sequence(F.floor((F.col("start") - after) / size), F.floor((F.col("end") + before) / size))
    marks = regions.filter(F.col("satt").isin(satts) & (F.col("start") <= F.col("end"))).select("corpus", F.explode(touched).alias("_block"), F.col("start").alias("cpos"), (-F.col("struc")).alias("_turn"), *own)
    rows = tokens.withColumn("_turn", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    # starts come before the token at their place
    w = Window.partitionBy("corpus", "_block").orderBy("cpos", F.col("_turn").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumns({f"_r_{s}": F.last(f"_r_{s}", True).over(w) for s in satts}).filter("_turn is null")
    out = []
    for s in satts:
        r = F.when(F.col(f"_r_{s}.end") >= F.col("cpos"), F.col(f"_r_{s}"))
        out += [r[c].alias(f"{s}_{n}") for n, c in (("id", "struc"), ("start", "start"), ("end", "end"), ("value", "value"))]
    return seen.select(*tokens.columns, *out)
