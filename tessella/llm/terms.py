"""Term statistics of collections: counted entries, frequencies, distinctiveness."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.skew import SALTS, weighted_join
from tessella.session import cut, partitions


def _name(c: str):
    return F.lower(F.trim(F.col(c)))


def resolve(rows: DataFrame, lexicon: DataFrame, att: str) -> DataFrame:
    """``rows`` with ``id`` filled in from ``name`` where it is null; others, and rows without either, go.

    Names are compared in lower case without blanks around them. Rows that
    bring an id take no part in the join, so its only heavy keys are names; the
    lexicon row of a heavy name is salted by ``weighted_join``, for which the
    names are counted first (one row per distinct name after map-side counts).
    """
    known = rows.filter("id is not null").drop("name")
    named = rows.filter("id is null").withColumn("name", _name("name")).filter("name <> ''")
    names = named.groupBy("name").agg(F.count("*").alias("w"))
    lex = lexicon.filter((F.col("att") == att) & F.col("id").isNotNull()).groupBy(_name("name").alias("name")).agg(F.min("id").alias("_id"))
    spread = [c for c in rows.columns if c not in ("id", "name")]
    found = weighted_join(named.drop("id"), names.join(lex, "name"), ["name"], "w", spread).withColumnRenamed("_id", "id").drop("name")
    return known.unionByName(found.select(known.columns))


def counted_entries(text_terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(corpus, text_id, id, freq) of the entries that count; several rows per (text, id) may remain.

    Of the deliveries of an entry_id the latest loaded_at holds; an equal
    loaded_at is settled by the largest row, so exact copies count once. A
    null loaded_at is earlier than any other. A row without an entry_id is an
    entry of its own. Holding rows with a null freq, or one below 1, are left
    out, as are rows with a null corpus or text_id.
    """
    cols = ["corpus", "text_id", "id", "name", "freq"]
    text_terms = text_terms.withColumn("name", F.when(F.col("id").isNull(), F.col("name")))  # else it isn't needed: don't shuffle it
    with_id = text_terms.filter("entry_id is not null").groupBy("entry_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", *cols)).alias("r")).select("r.*")
    held = with_id.unionByName(text_terms.filter("entry_id is null").select(cols))
    return resolve(held.filter("freq >= 1 and corpus is not null and text_id is not null"), lexicon, "word").select("corpus", "text_id", "id", "freq")


def last_seen_counts(entries: DataFrame) -> DataFrame:
    """Per (corpus, id): ``cf`` occurrences and ``df`` records, without sets of records.

    Entries are hash-partitioned on (corpus, id, salt), the salt a hash of the
    record, so a term in most records is spread over SALTS partitions and yet
    all its rows of one record meet. Sorted by (corpus, id, record), a
    partition is streamed past one counter per term that keeps occurrences,
    records and the last record seen; salts hold different records, so their
    counters add up exactly.
    """
    out = T.StructType([entries.schema["corpus"], entries.schema["id"], T.StructField("cf", T.LongType()), T.StructField("df", T.LongType())])
    spread = (
        entries.select("corpus", "id", "text_id", "freq", F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).alias("_salt"))
        .repartition(partitions(entries.sparkSession), "corpus", "id", "_salt")
        .sortWithinPartitions("corpus", "id", "text_id")
        .select("corpus", "id", "text_id", "freq")
    )
    counters = spread.mapInArrow(_counters, out)
    return counters.groupBy("corpus", "id").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    term, last, cf, df = None, None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        code = b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = b.column(1).to_numpy(zero_copy_only=False)
        text = b.column(2).to_numpy(zero_copy_only=False)
        freq = b.column(3).to_numpy(zero_copy_only=False)
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])
        record = new.copy()
        record[1:] |= text[1:] != text[:-1]
        at = np.flatnonzero(new)
        cfs = np.add.reduceat(freq, at).tolist()
        dfs = np.add.reduceat(record.astype(np.int64), at).tolist()
        corpora = b.column(0).take(pa.array(at)).to_pylist()
        terms = list(zip(corpora, ids[at].tolist(), strict=True))
        done: list[tuple] = []
        for k, (t, c, d) in enumerate(zip(terms, cfs, dfs, strict=True)):
            if k == 0 and t == term:
                cf += c
                df += d - (last == text[0])
            else:
                if term is not None:
                    done.append((*term, cf, df))
                term, cf, df = t, c, d
        last = text[-1]
        if done:
            cols = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(x, pa.int64()) for x in cols[1:]]], names=["corpus", "id", "cf", "df"])
    if term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([term[0]], pa.string()), *[pa.array([x], pa.int64()) for x in (term[1], cf, df)]], names=["corpus", "id", "cf", "df"])


def record_counts(entries: DataFrame, record: str = "text_id") -> DataFrame:
    """(corpus, n): the corpus's distinct records, counted after map-side distinct."""
    return entries.select("corpus", record).distinct().groupBy("corpus").agg(F.count("*").alias("n"))


def term_frequencies(text_terms: DataFrame, lexicon: DataFrame, common: float | str | Fraction = 0.1, rare_df: int = 3, rare_cf: int = 5) -> DataFrame:
    """(corpus, id, cf, df, n, mark) of every term of every corpus.

    mark is ``common`` for a df above ``common`` x n, else ``rare`` for a df
    below rare_df or a cf below rare_cf, else null. ``common`` is taken as the
    decimal (or fraction, as in "1/3") it is written as, and compared in integers. What counts is said at
    ``counted_entries``. Corpora are few; their record counts are joined as
    Spark sees fit. Terms only in null texts or corpora don't appear; an empty
    table gives an empty result.
    """
    entries = cut(counted_entries(text_terms, lexicon), "entries")
    n = record_counts(entries)
    terms = last_seen_counts(entries).join(n, "corpus")
    share = Fraction(str(common))
    wide = lambda c, k: F.col(c).cast("decimal(38,0)") * F.lit(k).cast("decimal(19,0)")
    mark = F.when(wide("df", share.denominator) > wide("n", share.numerator), "common").when((F.col("df") < rare_df) | (F.col("cf") < rare_cf), "rare")
    return terms.select("corpus", "id", "cf", "df", "n", mark.alias("mark"))


MIN_DF = 2


def distinctiveness(text_terms: DataFrame, lexicon: DataFrame, mu: float = 2000.0, min_df: int = MIN_DF, scores: tuple[str, ...] = ("divergence", "tfidf")) -> DataFrame:
    """Every term of every text, scored against its corpus.

    (corpus, text_id, id, freq, df, n) and the scores asked for. ``divergence`` is the term's
    contribution p ln(p / q) to the relative entropy between the text's
    Dirichlet-smoothed distribution p = (freq + mu q) / (length + mu) and the
    corpus's q = cf / total. ``tfidf`` is freq ln(n / df). Terms with a df below ``min_df``
    are left out of the result (though not out of lengths and totals).

    Frequencies are added up per (text, term) first; term statistics, one row
    per (corpus, term), are joined back with heavy terms salted. Lengths of texts are
    worked out and joined only for the divergence, salted alike, as a text may hold a third of all rows. Nulls as in counted_entries.
    """
    if unknown := set(scores) - {"divergence", "tfidf"}:
        raise ValueError(f"unknown scores {sorted(unknown)}")
    entries = cut(counted_entries(text_terms, lexicon).groupBy("corpus", "text_id", "id").agg(F.sum("freq").alias("freq")), "text-terms")
    totals = entries.groupBy("corpus", "text_id").agg(F.sum("freq").alias("length"), F.count("*").alias("w"))
    if "divergence" in scores:
        totals = cut(totals, "text-lengths")  # also read three times by the join of lengths
    stats = entries.groupBy("corpus", "id").agg(F.sum("freq").alias("cf"), F.count("*").alias("df"))
    corpora = totals.groupBy("corpus").agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    # read three times by the join below
    stats = cut(stats.join(corpora, "corpus").withColumn("w", F.col("df")), "term-statistics")
    scored = weighted_join(entries, stats.filter(F.col("df") >= min_df), ["corpus", "id"], "w", ["text_id"])
    out = [F.col(c) for c in ("corpus", "text_id", "id", "freq", "df", "n")]
    if "divergence" in scores:
        scored = weighted_join(scored, totals, ["corpus", "text_id"], "w", ["id"])
        q = F.col("cf") / F.col("total")
        p = (F.col("freq") + mu * q) / (F.col("length") + mu)
        out.append((p * F.log(p / q)).alias("divergence"))
    if "tfidf" in scores:
        out.append((F.col("freq") * F.log(F.col("n") / F.col("df"))).alias("tfidf"))
    return scored.select(*out)


def top_terms(scored: DataFrame, lexicon: DataFrame, score: str, k: int = 3) -> DataFrame:
    """(corpus, text_id, name, score): the up to k best terms of a text with a rounded score above 0, ties by name.

    Per text, terms are first cut to those whose score ranks k or better, which
    keeps ties; only these fetch their names. Spark's rank limit keeps k rows
    per text and task before the shuffle, so a huge text moves few rows.
    """
    w = Window.partitionBy("corpus", "text_id")
    s = F.round(score, 6).alias("score")
    best = scored.select("corpus", "text_id", "id", s).filter("score > 0").withColumn("r", F.rank().over(w.orderBy(F.desc("score")))).filter(F.col("r") <= k)
    names = lexicon.filter("att = 'word'").select("id", F.col("name"))
    return (
        best.join(names, "id")
        .withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "name")))
        .filter(F.col("r") <= k)
        .select("corpus", "text_id", "name", "score")
    )
