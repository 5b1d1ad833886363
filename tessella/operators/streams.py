"""Declared against counted positions of lexicon ids (the check of an inverted index)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.skew import key_runs


def stream_report(tokens: DataFrame, streams: DataFrame) -> DataFrame:
    """Every declared stream against what its corpus holds.

    One row per (corpus, id) of ``streams``: ``declared`` the sorted distinct
    non-null id_freq values, ``n_positions`` the distinct cpos counted by
    ``key_runs`` (0 if none), and ``wrong``: whether any declared value
    differs. Streams with only null values are not wrong. Rows with a null
    corpus or id are kept out on both sides.
    """
    counted = key_runs(tokens.filter("corpus is not null and id is not null"), ["corpus", "id"], "cpos").select("corpus", "id", "n_positions")
    declared = (
        streams.filter("corpus is not null and id is not null")
        .groupBy("corpus", "id")
        .agg(F.sort_array(F.collect_set("id_freq")).alias("declared"), F.min("id_freq").alias("lo"), F.max("id_freq").alias("hi"))
    )
    n = F.coalesce(F.col("n_positions"), F.lit(0).cast("long"))
    return declared.join(counted, ["corpus", "id"], "left").select(
        "corpus", "id", "declared", n.alias("n_positions"), F.coalesce((F.col("lo") != n) | (F.col("hi") != n), F.lit(False)).alias("wrong")
    )
