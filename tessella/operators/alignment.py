"""Parallel corpora: alignment constraints, translation of results, bead views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.model import Corpus, result
from tessella.operators.ranges import point_in_interval


def _bead_at(rows: DataFrame, at: str, beads: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with columns of the bead around a position, or nulls."""
    b = beads.select(F.col("source").alias("corpus"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), *[F.col(c).alias(n) for c, n in names.items()])
    return point_in_interval(rows, at, b, "_s1", "_s2", "left").drop("_s1", "_s2")


def windows(a: DataFrame, beads: DataFrame) -> DataFrame:
    """``a`` with the target window: from the start of the bead of match to the end of that of matchend; rows without either go."""
    rows = _bead_at(a, "match", beads, {"t1": "_lo", "target": "_other"})
    rows = _bead_at(rows, "matchend", beads, {"t2": "_hi"})
    return rows.filter("_lo is not null and _hi is not null and _lo <= _hi")


def aligned_filter(a: DataFrame, beads: DataFrame, hits: DataFrame, negated: bool = False) -> DataFrame:
    """Rows whose target window holds the start of a hit (or none). Unaligned rows go either way.

    ``beads`` lead to one target corpus, in which the hits are.
    """
    rows = windows(result(a), beads)
    spans = rows.select(F.col("_other").alias("corpus"), F.col("corpus").alias("_src"), F.col("match").alias("_m"), F.col("matchend").alias("_e"), "_lo", "_hi").distinct()
    found = point_in_interval(hits.select("corpus", F.col("match").alias("_p")).distinct(), "_p", spans, "_lo", "_hi").select(F.col("_src").alias("corpus"), F.col("_m").alias("match"), F.col("_e").alias("matchend")).distinct()
    return result(rows.join(found, ["corpus", "match", "matchend"], "left_anti" if negated else "left_semi"))


def translate(a: DataFrame, beads: DataFrame) -> DataFrame:
    """Each row as the target region of its start's bead; unaligned rows go, duplicates stay, the old order is the sort order."""
    from tessella.operators.refine import line_numbers

    rows = _bead_at(line_numbers(a, "_line"), "match", beads, {"t1": "_t1", "t2": "_t2", "target": "_other"})
    return result(rows.filter("_t1 is not null").select(F.col("_other").alias("corpus"), F.col("_t1").alias("match"), F.col("_t2").alias("matchend"), F.col("_line").alias("sort_rank")))


def bead_text(source: Corpus, target: Corpus, att: str = "word") -> DataFrame:
    """(source, target, bead, source_text, target_text): beads side by side."""
    beads = source.beads

    def side(c: Corpus, name: str, lo: str, hi: str, out: str) -> DataFrame:
        spans = beads.select(F.col(name).alias("corpus"), F.struct("source", "target", "bead").alias("_b"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
        hit = point_in_interval(c.tokens.select("corpus", "cpos", att), "cpos", spans, "_lo", "_hi")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cpos", att))), lambda x: x[att]), " ")
        return hit.groupBy("_b").agg(text.alias(out))

    return side(source, "source", "s1", "s2", "source_text").join(side(target, "target", "t1", "t2", "target_text"), "_b", "full").select("_b.*", "source_text", "target_text")


def aligned_text(a: DataFrame, beads: DataFrame, target: Corpus, att: str = "word") -> DataFrame:
    """(corpus, match, matchend, aligned_text): the target region aligned to each row, null where there is none."""
    rows = result(a).select("corpus", "match", "matchend").distinct()
    spans = windows(rows, beads).select(F.col("_other").alias("corpus"), F.struct("corpus", "match", "matchend").alias("_row"), "_lo", "_hi")
    hit = point_in_interval(target.tokens.select("corpus", "cpos", F.coalesce(att, F.lit("")).alias("_t")), "cpos", spans, "_lo", "_hi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cpos", "_t"))), lambda x: x["_t"]), " ")
    texts = hit.groupBy("_row").agg(text.alias("aligned_text")).select("_row.*", "aligned_text")
    return rows.join(texts, ["corpus", "match", "matchend"], "left")
