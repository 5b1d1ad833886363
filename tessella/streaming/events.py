"""Extension: event streams. Not part of the corpus language, which reads finished corpora only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows with a watermark; for batch and streaming frames alike."""
    frame = events.withWatermark("ts", late) if events.isStreaming else events
    counted = frame.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def live_ngrams(tokens: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(corpus, word, n) of tokens that arrive with a ``loaded_at``; repeated (corpus, cpos) within the watermark count once."""
    frame = tokens.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["corpus", "cpos"]) if tokens.isStreaming else tokens.dropDuplicates(["corpus", "cpos"])
    return frame.groupBy("corpus", "word").agg(F.count("*").alias("n"))
