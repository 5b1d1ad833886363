"""Co-occurrence: windowed meets, unions, and gapped token sequences (TAB)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.model import Corpus, result
from tessella.operators.refine import first_rows
from tessella.operators.sequence import _boundary, with_frequencies
from tessella.plans.language import Meet, MUQuery, TABQuery, Tok, UnionOf
from tessella.plans.predicates import Compiler

WIDTH = 1024


def positions(corpus: Corpus, tok: Tok, variables: dict | None = None) -> DataFrame:
    """(corpus, cpos) of the tokens that pass a test."""
    tokens = with_frequencies(corpus, [tok.test])
    return tokens.filter(Compiler(corpus.patts, corpus.satts, variables, functions=corpus.functions).test(tok.test)).select("corpus", "cpos")


def meet(a: DataFrame, b: DataFrame, lo: int, hi: int, compat_edge: bool = False) -> DataFrame:
    """Positions of ``a`` with one of ``b`` in [a + lo, a + hi].

    A left-semi join on (corpus, bucket): each of ``a`` looks into the buckets its
    window touches. The window is clamped at the corpus's edges; ``compat_edge``
    drops positions whose left edge lies before 0 instead.
    """
    if compat_edge and lo < 0:
        a = a.filter(F.col("cpos") >= -lo)
    width = max(WIDTH, hi - lo + 1)
    left = a.withColumn("_b", F.explode(F.sequence(F.floor((F.col("cpos") + lo) / width), F.floor((F.col("cpos") + hi) / width)) if hi >= lo else F.array().cast("array<bigint>")))
    right = b.select(F.col("corpus").alias("_c"), F.col("cpos").alias("_p"), F.floor(F.col("cpos") / width).alias("_rb"))
    on = (F.col("corpus") == F.col("_c")) & (F.col("_b") == F.col("_rb")) & (F.col("_p") - F.col("cpos")).between(lo, hi)
    return left.join(right, on, "left_semi").select("corpus", "cpos").distinct()


def meet_region(corpus: Corpus, a: DataFrame, b: DataFrame, satt: str) -> DataFrame:
    """Positions of ``a`` with one of ``b`` in the same region; the regions of ``b`` are made distinct first."""
    ids = corpus.tokens.select("corpus", "cpos", F.col(f"{satt}_id").alias("_id")).filter("_id is not null")
    there = b.join(ids, ["corpus", "cpos"]).select("corpus", "_id").distinct()
    return a.join(ids, ["corpus", "cpos"]).join(there, ["corpus", "_id"], "left_semi").select("corpus", "cpos")


def _tree(corpus: Corpus, node: object, variables: dict | None, compat_edge: bool) -> DataFrame:
    if isinstance(node, Tok):
        return positions(corpus, node, variables)
    a, b = (_tree(corpus, x, variables, compat_edge) for x in (node.left, node.right))
    if isinstance(node, UnionOf):
        return a.unionByName(b).distinct()
    assert isinstance(node, Meet)
    return meet_region(corpus, a, b, node.satt) if node.satt else meet(a, b, node.lo, node.hi, compat_edge)


def run_mu(corpus: Corpus, query: MUQuery, variables: dict | None = None, compat_edge: bool = False) -> DataFrame:
    found = _tree(corpus, query.tree, variables, compat_edge).select("corpus", F.col("cpos").alias("match"), F.col("cpos").alias("matchend"))
    return _cut(result(found), query.cut)


def _cut(found: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return found
    return first_rows(found, ["match", "matchend"], n)


def run_tab(corpus: Corpus, query: TABQuery, variables: dict | None = None) -> DataFrame:
    """Greedy gapped sequence: from each first token the first fitting second one, from there the third, and so on.

    Each step is an as-of join: the least position at or after the lower bound,
    found by one ordered window over blocks with the first position of every
    later block carried backwards; an upper bound then filters. Of results with
    one end only the earliest start stays, as ends must increase.
    """
    tokens = with_frequencies(corpus, [c.test for c in query.columns])
    tokens, bound, _ = _boundary(corpus, query.within, tokens)
    compiler = Compiler(corpus.patts, corpus.satts, variables, functions=corpus.functions)
    cols = [tokens.filter(compiler.test(c.test)).select("corpus", "cpos") for c in query.columns]
    here = tokens.filter(compiler.test(query.columns[0].test)).select("corpus", F.col("cpos").alias("match"), F.col("cpos").alias("matchend"), bound.alias("_bound")).filter("_bound is not null")
    for (lo, hi), col in zip(query.gaps, cols[1:], strict=True):
        here = _next(here, col, lo).filter(F.col("_at") <= F.col("_bound"))
        if hi is not None:
            here = here.filter(F.col("_at") <= F.col("matchend") + hi)
        here = here.withColumn("matchend", F.col("_at")).drop("_at")
    # ends don't fall as starts rise, so results nested in an earlier one share its end
    first = here.groupBy("corpus", "matchend").agg(F.min("match").alias("match"))
    return _cut(result(first), query.cut)


def _next(here: DataFrame, col: DataFrame, lo: int) -> DataFrame:
    """``here`` with ``_at``, the first position of ``col`` at or after matchend + lo.

    Both are put in order in one table by blocks; the minimum over the following
    rows of a block, or else the first position of a later block, is the answer.
    """
    from pyspark.sql import Window

    block = lambda c: F.floor(c / 65536)
    a = here.withColumn("_q", F.col("matchend") + lo)
    marks = a.select("corpus", F.col("_q").alias("_k"), F.lit(None).cast("long").alias("_p"), F.struct("match", "matchend", "_bound").alias("_row"))
    hits = col.select("corpus", F.col("cpos").alias("_k"), F.col("cpos").alias("_p"), F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"))
    both = marks.unionByName(hits).withColumn("_b", block(F.col("_k")))
    # backwards, so that the frame grows: frames that shrink are summed up anew for every row
    w = Window.partitionBy("corpus", "_b").orderBy(F.desc("_k")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_near", F.min("_p").over(w)).filter("_row is not null")
    firsts = both.groupBy("corpus", "_b").agg(F.min("_p").alias("_first"))
    after = Window.partitionBy("corpus").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    later = firsts.select("corpus", "_b", F.min("_first").over(after).alias("_later"))
    return near.join(later, ["corpus", "_b"]).select("corpus", "_row.*", F.coalesce("_near", "_later").alias("_at")).filter("_at is not null")
