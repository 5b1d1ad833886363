"""Results on disk: saved results, text dumps of intervals and their import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.model import RESULT, Corpus, result
from tessella.operators.display import dump


def save(a: DataFrame, path: str) -> None:
    result(a).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*RESULT)


def write_dump(a: DataFrame, path: str) -> None:
    """Four TAB columns in sort order, -1 for undefined, one sorted file set."""
    rows = dump(a)
    rows.repartitionByRange("corpus", "line").sortWithinPartitions("corpus", "line").select(F.concat_ws("\t", "match", "matchend", "target", "keyword").alias("value")).write.mode("overwrite").text(path)


def _checked(rows: DataFrame, good: Column, problem: str) -> DataFrame:
    """``rows``, whose reading fails at one that isn't good."""
    what = F.concat(F.lit(f"{problem}: line "), F.coalesce(F.col("line").cast("string"), F.lit("?")))
    return rows.withColumn("match", F.when(good, F.col("match")).otherwise(F.raise_error(what).cast("long")))


def undump(corpus: Corpus, rows: DataFrame, ascending: bool = False) -> DataFrame:
    """A result from (corpus, line, match, matchend[, target[, keyword]]).

    Wants 0 <= match <= matchend < size, and anchors within the corpus or -1; anything else is an error when
    the result is computed. ``ascending`` wants rows sorted and without overlap; otherwise the line order becomes the sort order.
    """
    have = set(rows.columns)
    anchors = [c for c in ("target", "keyword") if c in have]
    sized = rows.join(corpus.size(), "corpus", "left")
    bad = F.col("size").isNull() | (F.col("match") < 0) | (F.col("match") > F.col("matchend")) | (F.col("matchend") >= F.col("size"))
    for c in anchors:
        bad = bad | (F.col(c) < -1) | (F.col(c) >= F.col("size"))
    out = _checked(sized, ~F.coalesce(bad, F.lit(True)), "not an interval of the corpus")
    for c in anchors:
        out = out.withColumn(c, F.nullif(F.col(c), F.lit(-1).cast("long")))
    if ascending:
        from tessella.sources.vertical import next_in_order

        after = next_in_order(out, ["corpus"], "line", F.col("match"), "_next")
        return result(_checked(after, F.coalesce(F.col("_next") > F.col("matchend"), F.lit(True)), "rows overlap or aren't ascending"))
    return result(out.withColumn("sort_rank", F.col("line")))
