"""Items that appear together in one record, over all records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.terms import record_counts, resolve
from tessella.operators.skew import weighted_join
from tessella.session import cut


def basket_items(region_items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct (corpus, text_id, id); rows with a null corpus or text_id, or without id and name, don't count."""
    rows = region_items.filter("corpus is not null and text_id is not null").select("corpus", "text_id", "id", "name")
    return resolve(rows, lexicon, "category").select("corpus", "text_id", "id").distinct()


def associations(items: DataFrame, min_count: int = 5, min_lift: float = 4.0, chunk: int = 128) -> DataFrame:
    """(corpus, id_a, id_b, n_ab, n_a, n_b, n, lift) with id_a < id_b.

    ``items`` are distinct (corpus, text_id, id). Pairs have n_ab >= min_count
    and lift = n_ab n / (n_a n_b) >= min_lift. Since n_ab is at most the
    smaller of n_a and n_b, items with n_a < min_count or n_a min_lift > n
    are in no such pair; they are dropped before pairing without loss.

    Baskets of more than ``chunk`` items are split into item chunks by hash,
    about ``chunk`` items each, and each pair of chunks is a row of its own
    that a round-robin shuffle hands to any task, so the product of a huge
    basket is shared by all. An ordinary basket is one chunk, paired with
    itself. Pairs are exploded from the two arrays and counted map-side before
    they are shuffled. Basket sizes are joined back with heavy baskets salted.
    """
    items = cut(items, "items")
    n = record_counts(items)
    sizes = items.groupBy("corpus", "id").agg(F.count("*").alias("n_i")).join(n, "corpus")
    able = cut(sizes.filter((F.col("n_i") >= min_count) & (F.col("n_i") * F.lit(min_lift) <= F.col("n"))).withColumn("w", F.col("n_i")), "item-counts")
    kept = cut(weighted_join(items, able.select("corpus", "id", "w"), ["corpus", "id"], "w", ["text_id"]), "kept-items")
    baskets = kept.groupBy("corpus", "text_id").agg(F.count("*").alias("m")).filter("m > 1").withColumn("w", F.col("m"))
    chunked = (
        weighted_join(kept, baskets, ["corpus", "text_id"], "w", ["id"])
        .withColumn("k", F.ceil(F.col("m") / chunk).cast("int"))
        .groupBy("corpus", "text_id", "k", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("c"))
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    # every chunk meets every other once: chunk c goes to the pairs (i, j), i <= j, that hold it
    small = chunked.filter("k = 1").select("corpus", F.col("ids").alias("x"), F.col("ids").alias("y"), F.lit(True).alias("same"))
    large = chunked.filter("k > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    large = (
        large.groupBy("corpus", "text_id", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"))
        .agg(F.min_by("ids", "c").alias("x"), F.max_by("ids", "c").alias("y"), F.count("*").alias("present"))
        .filter((F.col("i") == F.col("j")) | (F.col("present") == 2))  # hashing may leave a chunk empty
        .select("corpus", "x", "y", (F.col("i") == F.col("j")).alias("same"))
        .repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    )
    product = small.unionByName(large).withColumn("a", F.explode("x")).select("corpus", "a", "same", F.explode("y").alias("b")).filter("not same or a < b")
    pairs = (
        product.groupBy("corpus", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
        .agg(F.count("*").alias("n_ab"))
        .filter(F.col("n_ab") >= min_count)
    )
    a = able.select("corpus", F.col("id").alias("id_a"), F.col("n_i").alias("n_a"), "n")
    b = able.select("corpus", F.col("id").alias("id_b"), F.col("n_i").alias("n_b"))
    scored = pairs.join(a, ["corpus", "id_a"]).join(b, ["corpus", "id_b"])
    held = F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b")
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return scored.filter(held).select("corpus", "id_a", "id_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"))
