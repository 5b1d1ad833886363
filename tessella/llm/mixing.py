"""Mixing sources to target weights, by weighted fair queueing over token counts."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.skew import running_sum, weighted_join
from tessella.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``documents`` without ``text``, with ``out``: the text's tokens under a public vocabulary of ranks.

    The vocabulary, a file of fixed size under 1 MB, is read once on the driver
    and broadcast. Whole texts are counted, in Arrow batches; a null text gives null.
    A column that ``out`` clashes with is replaced.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kept = [c for c in documents.columns if c not in (text, out)]
    schema = T.StructType([*[documents.schema[c] for c in kept], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            counts = [None if t is None else len(encoding.encode_ordinary(t)) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(counts, pa.int64())], names=[*kept, out])

    return documents.select(*kept, text).mapInArrow(run, schema)


def _plans(counted: DataFrame, targets: DataFrame, budget: int | None, exact: bool) -> DataFrame:
    """One row per (mix, source) with documents: share among these, repeats, tokens there are, the mix's total and the reach.

    A source fills its share up to its capacity, its tokens times its repeats. Up to virtual time v it brings
    min(capacity, share x v), so a mix's tokens grow with v piece by piece, ever slower. reach is
    the v at which they exceed the total by every source's longest document: documents beyond can't lie within the total.
    """
    there = counted.groupBy("source").agg(F.sum("n_tokens").alias("there"), F.max("n_tokens").alias("longest"), F.count("*").alias("w"))
    wanted = (
        targets.filter("mix_id is not null and source is not null and target_share > 0")
        .groupBy("mix_id", "source")
        .agg(F.sum("target_share").alias("target"), F.greatest(F.coalesce(F.min("max_repeats"), F.lit(1)), F.lit(0)).alias("repeats"))
    )
    both = wanted.join(there, "source").filter("there > 0 and repeats > 0").withColumn("capacity", F.col("there") * F.col("repeats"))
    of = both.groupBy("mix_id").agg(F.sum("target").alias("all"), F.sum("longest").alias("slack"), F.sum("capacity").alias("capacities"))
    both = both.join(of, "mix_id").withColumn("share", F.col("target") / F.col("all")).withColumn("full", F.col("capacity") / F.col("share"))
    most = F.min("full") if budget is None or exact else F.lit(None).cast("double")
    total = both.groupBy("mix_id").agg(F.floor(F.least(most, F.lit(budget).cast("double"), F.max("capacities").cast("double"))).cast("long").alias("total"))
    both = both.join(total, "mix_id").withColumn("goal", F.col("total") + F.col("slack"))
    # sources in the order in which they run out; one row each, so a mix is a small group
    order = Window.partitionBy("mix_id").orderBy("full", "source")
    spent = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("share").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    at = both.withColumn("v", (F.col("goal") - spent) / left)
    # the goal lies in the piece before the first source that has not run out by then, whose v is the largest that fits its piece
    reach = at.groupBy("mix_id").agg(F.coalesce(F.max(F.when(F.col("v") <= F.col("full"), F.col("v"))), F.max("full")).alias("reach"))
    return both.join(reach, "mix_id").select("mix_id", "source", "share", "repeats", "there", "w", "total", "reach")


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY, exact: bool = False) -> DataFrame:
    """(mix_id, source, doc_id, repeat, n_tokens, finish, running_tokens): the documents of every mix, in the order of running_tokens.

    A source's documents are shuffled by a seeded hash. A document's virtual
    finish time is the source's cumulative tokens up to it, over all repeats so
    far, divided by the source's weight. All documents of a mix are range-sorted
    by finish time and cut where their running total passes the mix's budget:
    then each source is within one document of share x budget. Both sums
    run over range partitions with stitched offsets, so a source (or a mix)
    that holds most rows is cut into many tasks.

    Without ``budget`` a mix is the largest in which every source has its target share under max_repeats.
    A stated budget is filled to within one document: sources that run out give all they have
    under max_repeats, and the others share the rest in proportion to their targets (``shares`` reports what came of it). With
    ``exact``, shares go before the budget, and the mix is no larger than without one. A
    budget beyond all sources' repeats takes everything. Shares of sources without documents (or with max_repeats below 1) go to the
    others in proportion; ``shares`` shows them as missed. repeat counts from
    0. Rows with a null doc_id, source or text take no part; an empty text has
    0 tokens and goes with its predecessor. Of repeated target rows shares add up and the
    least max_repeats holds; a null max_repeats is 1.
    """
    counted = cut(count_tokens(documents.filter("doc_id is not null and source is not null and text is not null").select("doc_id", "source", "text"), vocabulary), "counted")
    return _queue(counted, targets, budget, seed, exact)


def _queue(counted: DataFrame, targets: DataFrame, budget: int | None, seed: int, exact: bool = False) -> DataFrame:
    plans = cut(_plans(counted, targets, budget, exact), "plans")
    per_source = plans.groupBy("source").agg(F.first("w").alias("w"), F.collect_list(F.struct("mix_id", "share", "repeats", "there", "total", "reach")).alias("plan"))
    shuffled = counted.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    summed = running_sum(shuffled, ["source"], ["key", "doc_id", "n_tokens"], "n_tokens", "upto")
    rows = weighted_join(summed, per_source, ["source"], "w", ["doc_id"]).withColumn("p", F.explode("plan")).select("source", "doc_id", "n_tokens", "upto", "p.*")
    # repeats whose finish time lies within reach
    last = F.least(F.col("repeats") - 1, F.floor((F.col("share") * F.col("reach") - F.col("upto")) / F.col("there")))
    rows = rows.filter(last >= 0).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    rows = rows.withColumn("finish", (F.col("repeat") * F.col("there") + F.col("upto")) / F.col("share"))
    queued = running_sum(rows.select("mix_id", "finish", "source", "doc_id", "repeat", "n_tokens", "total"), ["mix_id"], ["finish", "source", "repeat", "doc_id"], "n_tokens", "running_tokens")
    return queued.filter(F.col("running_tokens") <= F.col("total")).select("mix_id", "source", "doc_id", F.col("repeat").cast("int").alias("repeat"), "n_tokens", "finish", "running_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, share, tokens, documents, most_repeats): what each source reached; 0 for those that couldn't."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), (F.max("repeat") + 1).alias("most_repeats"))
    total = got.groupBy("mix_id").agg(F.sum("tokens").alias("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    wanted = targets.filter("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"))
    return (
        wanted.join(got, ["mix_id", "source"], "left")
        .join(total, "mix_id", "left")
        .select("mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"), zero("tokens"), zero("documents"), zero("most_repeats"))
    )
