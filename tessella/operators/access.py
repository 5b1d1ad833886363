"""Access functions of the library interface: lexicon, positions, regions, beads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.regex import matches
from tessella.model import Corpus
from tessella.operators.ranges import point_in_interval
from tessella.operators.skew import running_sum, weighted_join


def max_cpos(c: Corpus, att: str) -> DataFrame:
    """(corpus, max_cpos): the number of positions."""
    return c.tokens.groupBy("corpus").agg((F.max("cpos") + 1).alias("max_cpos"))


def max_id(c: Corpus, att: str) -> DataFrame:
    """(corpus, max_id): the number of types."""
    return c.tokens.filter(F.col(att).isNotNull()).groupBy("corpus").agg(F.count_distinct(att).alias("max_id"))


def max_struc(c: Corpus, satt: str) -> DataFrame:
    """(corpus, max_struc): the number of regions."""
    return c.regions.filter(F.col("satt") == satt).groupBy("corpus").agg(F.count("*").alias("max_struc"))


def max_alg(c: Corpus) -> DataFrame:
    """(source, target, max_alg): the number of beads of a pair."""
    return c.beads.groupBy("source", "target").agg(F.count("*").alias("max_alg"))


def has_extended_alignment(c: Corpus) -> bool:
    """Beads here always have their own intervals on both sides."""
    return c.beads is not None


def struc_has_values(c: Corpus, satt: str) -> DataFrame:
    """(corpus, has_values): whether any region of an attribute has a value."""
    return c.regions.filter(F.col("satt") == satt).groupBy("corpus").agg((F.count("value") > 0).alias("has_values"))


def attribute_size(c: Corpus, att: str) -> DataFrame:
    """(corpus, size): tokens of a p-attribute, regions of an s-attribute."""
    rows = c.regions.filter(F.col("satt") == att) if att in c.satts else c.tokens
    return rows.groupBy("corpus").agg(F.count("*").alias("size"))


def lexicon_size(c: Corpus, att: str) -> DataFrame:
    return c.tokens.groupBy("corpus").agg(F.count_distinct(att).alias("size"))


def str2id(c: Corpus, att: str, strings: list[str]) -> DataFrame:
    return c.lexicon(att).filter(F.col(att).isin(strings)).select("corpus", att, "id")


def id2str(c: Corpus, att: str, ids: list[int]) -> DataFrame:
    return c.lexicon(att).filter(F.col("id").isin(ids)).select("corpus", "id", att)


def id2strlen(c: Corpus, att: str, ids: list[int]) -> DataFrame:
    """(corpus, id, len): bytes of the string."""
    return id2str(c, att, ids).select("corpus", "id", F.octet_length(att).cast("long").alias("len"))


def id2sort(c: Corpus, att: str, ids: list[int]) -> DataFrame:
    """(corpus, id, rank): where an id stands in byte order."""
    return sort_index(c, att).filter(F.col("id").isin(ids)).select("corpus", "id", "rank")


def sort2id(c: Corpus, att: str, ranks: list[int]) -> DataFrame:
    """(corpus, rank, id): the id at a place in byte order."""
    return sort_index(c, att).filter(F.col("rank").isin(ranks))


def id2freq(c: Corpus, att: str, ids: list[int]) -> DataFrame:
    return c.lexicon(att).filter(F.col("id").isin(ids)).select("corpus", "id", "freq")


def idlist2freq(c: Corpus, att: str, ids: list[int]) -> DataFrame:
    return id2freq(c, att, ids).groupBy("corpus").agg(F.sum("freq").alias("freq"))


def regex2id(c: Corpus, att: str, pattern: str, flags: str = "") -> DataFrame:
    return c.lexicon(att).filter(matches(F.col(att), pattern, flags)).select("corpus", "id")


def sort_index(c: Corpus, att: str) -> DataFrame:
    """(corpus, rank, id): ids in byte order of their strings."""
    ranked = running_sum(c.lexicon(att).withColumn("_one", F.lit(1).cast("long")), ["corpus"], [att], "_one", "_upto")
    return ranked.select("corpus", (F.col("_upto") - 1).alias("rank"), "id")


def id2cpos(c: Corpus, att: str, ids: list[int], ranges: DataFrame | None = None) -> DataFrame:
    """(corpus, id, cpos), within (corpus, lo, hi) if given."""
    lex = id2str(c, att, ids)
    hit = c.tokens.select("corpus", "cpos", att).join(lex, ["corpus", att]).select("corpus", "id", "cpos")
    if ranges is None:
        return hit
    return point_in_interval(hit, "cpos", ranges.select("corpus", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "_lo", "_hi").select("corpus", "id", "cpos")


def cpos2str(c: Corpus, att: str, cpos: list[int]) -> DataFrame:
    return c.tokens.filter(F.col("cpos").isin(cpos)).select("corpus", "cpos", att)


def cpos2id(c: Corpus, att: str, cpos: list[int] | None = None) -> DataFrame:
    """(corpus, cpos, id) of the positions (without a list, of all); heavy types are salted."""
    rows = c.tokens.select("corpus", "cpos", att) if cpos is None else cpos2str(c, att, cpos)
    return weighted_join(rows, c.lexicon(att), ["corpus", att], "freq", ["cpos"]).select("corpus", "cpos", "id")


def cpos2struc(c: Corpus, satt: str, cpos: list[int] | DataFrame | None = None) -> DataFrame:
    """(corpus, cpos, struc, lbound, rbound, value, flags): 1 within a region, 2 at its start, 4 at its end, added up; 0 outside.

    ``cpos`` lists positions of each corpus, or is a table (corpus, cpos); without it, all positions come out.
    """
    s, e = F.col(f"{satt}_start"), F.col(f"{satt}_end")
    flags = F.when(s.isNull(), F.lit(0).cast("long")).otherwise(1 + 2 * (F.col("cpos") == s).cast("long") + 4 * (F.col("cpos") == e).cast("long"))
    if cpos is None:
        rows = c.tokens
    elif isinstance(cpos, DataFrame):
        rows = c.tokens.join(cpos.select("corpus", "cpos"), ["corpus", "cpos"], "left_semi")
    else:
        rows = c.tokens.filter(F.col("cpos").isin(cpos))
    return rows.select("corpus", "cpos", F.col(f"{satt}_id").alias("struc"), s.alias("lbound"), e.alias("rbound"), F.col(f"{satt}_value").alias("value"), flags.alias("flags"))


def struc2cpos(c: Corpus, satt: str, strucs: list[int]) -> DataFrame:
    return c.regions.filter((F.col("satt") == satt) & F.col("struc").isin(strucs)).select("corpus", "struc", "start", "end", "value")


def cpos2alg(c: Corpus, cpos: list[int] | None = None) -> DataFrame:
    """(corpus, cpos, target, bead): the bead of each position (without a list, of all), by target."""
    rows = (c.tokens if cpos is None else c.tokens.filter(F.col("cpos").isin(cpos))).select("corpus", "cpos")
    beads = c.beads.select(F.col("source").alias("corpus"), "target", "bead", F.col("s1").alias("_lo"), F.col("s2").alias("_hi"))
    return point_in_interval(rows, "cpos", beads, "_lo", "_hi").select("corpus", "cpos", "target", "bead")


def alg2cpos(c: Corpus, beads: list[int]) -> DataFrame:
    return c.beads.filter(F.col("bead").isin(beads)).select("source", "target", "bead", "s1", "s2", "t1", "t2")


def positions_in_order(c: Corpus, att: str, value: str) -> DataFrame:
    """(corpus, cpos) ascending, to be read as a stream by ``toLocalIterator``."""
    return c.tokens.filter(F.col(att) == value).select("corpus", "cpos").orderBy("corpus", "cpos")
