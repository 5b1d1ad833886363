"""Sentence alignment of parallel corpora by shared features, within pre-aligned regions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.folding import fold_text
from tessella.model import Corpus
from tessella.session import cut

STEPS = ((1, 0), (0, 1), (1, 1), (1, 2), (2, 1), (2, 2))
BEADS = "source string, target string, s1 bigint, s2 bigint, t1 bigint, t2 bigint, kind string, quality bigint"


@dataclass(frozen=True)
class Features:
    """Weights of what two sentences may share: characters, words of like frequency, letter n-grams, a bilingual list."""

    characters: int = 1
    shared: int = 50
    threshold: float = 0.4
    ngrams: tuple[tuple[int, int], ...] = ((3, 3), (4, 4))
    pairs: int = 0
    beam: int = 50
    split: float = 1.2


def shared_words(source: Corpus, target: Corpus, pairs: DataFrame, att: str, threshold: float) -> DataFrame:
    """(source, target, w): words of both corpora of a pair, each side with at least ``threshold`` of their joint frequency."""
    a = source.tokens.filter(F.col(att).isNotNull()).groupBy(F.col("corpus").alias("source"), F.col(att).alias("w")).agg(F.count("*").alias("a"))
    b = target.tokens.filter(F.col(att).isNotNull()).groupBy(F.col("corpus").alias("target"), F.col(att).alias("w")).agg(F.count("*").alias("b"))
    least = F.least("a", "b") / (F.col("a") + F.col("b"))
    return a.join(pairs, "source").join(b, ["target", "w"]).filter(least >= threshold).select("source", "target", "w", F.lit(True).alias("shared"))


def _keys(c: Corpus, side: str, pre: str, by: str) -> DataFrame:
    """(side, key): what pre-aligns the regions of ``pre``."""
    rows = c.regions.filter(F.col("satt") == pre)
    first = rows.groupBy("corpus").agg(F.min("struc").alias("_first"))
    key = F.col("value") if by == "value" else (F.col("struc") - F.col("_first")).cast("string")
    return rows.join(first, "corpus").select(F.col("corpus").alias(side), key.alias("key")).filter("key is not null").distinct()


def _sentences(c: Corpus, side: str, keys: DataFrame, satt: str, pre: str, att: str, marks: list[tuple[DataFrame, list[str]]], by: str) -> DataFrame:
    """The words of one side of every pair, in regions that the other side has as well; a corpus in several pairs comes once for each."""
    first = c.regions.filter(F.col("satt") == pre).groupBy("corpus").agg(F.min("struc").alias("_first"))
    key = F.col(f"{pre}_value") if by == "value" else (F.col(f"{pre}_id") - F.col("_first")).cast("string")
    rows = c.tokens.join(first, "corpus").filter(F.col(f"{satt}_id").isNotNull() & F.col(f"{pre}_id").isNotNull())
    rows = rows.select(F.col("corpus").alias(side), key.alias("key"), "cpos", F.col(f"{satt}_start").alias("s"), F.col(f"{satt}_end").alias("e"), F.coalesce(att, F.lit("")).alias("w"))
    rows = rows.join(keys, [side, "key"])
    for m, on in marks:
        rows = rows.join(m, on, "left")
    return rows


def align(source: Corpus, target: Corpus, satt: str = "s", pre: str = "text", by: str = "ordinal", att: str = "word", features: Features = Features(), word_list: DataFrame | None = None, corpora: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Beads of sentences: (source, target, s1, s2, t1, t2, kind, quality), an empty side ending before it starts.

    Every pair of ``corpora`` (source, target) is aligned by itself; without it, each corpus of
    ``source`` with each of ``target``. Regions of ``pre`` with the same number or value are pre-aligned; each pair of them is one group, in
    which the best path over 1:0, 0:1, 1:1, 2:1, 1:2 and 2:2 steps is found in a band (``_beads``). A
    2:2 bead no better than ``split`` times the two 1:1 beads in it is split.
    ``word_list`` (source, target) adds bilingual pairs. Regions on one side only give no beads.
    """
    f = features
    if corpora is None:
        corpora = source.tokens.select(F.col("corpus").alias("source")).distinct().crossJoin(target.tokens.select(F.col("corpus").alias("target")).distinct())
    corpora = cut(corpora.select("source", "target").distinct(), "corpus-pairs")
    both = ["source", "target", "w"]
    shared = cut(shared_words(source, target, corpora, att, f.threshold), "shared-words")
    marks_s, marks_t = [(shared, both)], [(shared.select(*[F.col(c).alias(c) for c in shared.columns]), both)]
    pairs = word_list is not None and f.pairs > 0
    if pairs:
        listed = word_list.select("source", "target").distinct().withColumn("pair", F.concat_ws("\u0001", "source", "target"))
        marks_s.append((listed.groupBy(F.col("source").alias("w")).agg(F.collect_set("pair").alias("pairs")), ["w"]))
        marks_t.append((listed.groupBy(F.col("target").alias("w")).agg(F.collect_set("pair").alias("pairs")), ["w"]))
    keys = cut(_keys(source, "source", pre, by).join(corpora, "source").join(_keys(target, "target", pre, by), ["target", "key"]), "aligned-regions")
    a = _sentences(source, "source", keys, satt, pre, att, marks_s, by)
    b = cut(_sentences(target, "target", keys, satt, pre, att, marks_t, by), "sentences")  # both may come from one table

    def group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["source", "target", "s1", "s2", "t1", "t2", "kind", "quality"])
        x, y = _bags(left, f, pairs), _bags(right, f, pairs)
        rows = [(left["source"].iloc[0], left["target"].iloc[0], *r) for r in _beads(x, y, f)]
        return pd.DataFrame(rows, columns=["source", "target", "s1", "s2", "t1", "t2", "kind", "quality"])

    on = ["source", "target", "key"]
    return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(lambda left, right: group(left, right), BEADS)


def _grams(word: str, ngrams: tuple[tuple[int, int], ...]) -> list[tuple[int, str, int]]:
    folded = fold_text(word, "cd")
    return [(n, folded[k : k + n], weight) for n, weight in ngrams for k in range(len(folded) - n + 1)]


def _bags(rows: pd.DataFrame, f: Features, pairs: bool) -> list[tuple[int, int, int, Counter]]:
    """(start, end, characters, weighted features) of each sentence."""
    out: list[tuple[int, int, int, Counter]] = []
    grams: dict[str, list] = {}  # of this group's words
    rows = rows.sort_values("cpos", kind="stable")
    lists = rows["pairs"].tolist() if pairs else [None] * len(rows)
    begun, end, chars, bag = None, 0, 0, Counter()
    for s, e, w, shared, listed in zip(rows["s"].tolist(), rows["e"].tolist(), rows["w"].tolist(), rows["shared"].tolist(), lists, strict=True):
        if s != begun:
            if begun is not None:
                out.append((begun, end, chars, bag))
            begun, end, chars, bag = s, e, 0, Counter()
        chars += len(w)
        if shared is True:
            bag["w", w, f.shared] += 1
        if w not in grams:
            grams[w] = _grams(w, f.ngrams)
        bag.update(grams[w])
        if listed is not None and not isinstance(listed, float):
            bag.update(("p", p, f.pairs) for p in listed)
    if begun is not None:
        out.append((begun, end, chars, bag))
    return out


LOST = -(1 << 60)


class _Side:
    """Sentences of one side, by themselves and by twos, with their features as sparse rows."""

    def __init__(self, bags: list[tuple[int, int, int, Counter]], ids: dict[tuple, int]) -> None:
        ones = [(chars, {ids[k]: c for k, c in bag.items() if k in ids}) for _, _, chars, bag in bags]
        twos = [(p + q, dict(Counter(a) + Counter(b))) for (p, a), (q, b) in zip(ones, ones[1:])]  # noqa: B905
        self.chars, self.ends, self.ids, self.counts = {}, {}, {}, {}
        for d, rows in ((1, ones), (2, twos)):
            self.chars[d] = np.array([c for c, _ in rows], np.int64)
            self.ends[d] = np.concatenate(([0], np.cumsum([len(r) for _, r in rows], dtype=np.int64)))
            self.ids[d] = np.array([k for _, r in rows for k in r], np.int64)
            self.counts[d] = np.array([c for _, r in rows for c in r.values()], np.int64)

    def row(self, d: int, i: int, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        at = slice(self.ends[d][i], self.ends[d][i + 1])
        out[self.ids[d][at]] = self.counts[d][at]
        return out


def _beads(x: list, y: list, f: Features) -> list[tuple]:
    """The best path through the grid of sentence counts, row by row.

    Row i holds what the first i sentences of x are worth with the first j of y, for the
    j in a band of ``beam`` to either side of where the shares of characters seen are equal. Bands
    of neighbouring rows touch, so a path to the end always exists. Of equal
    steps the first in the order of STEPS holds.
    """
    # features on one side only add nothing; the others are numbered
    there = set().union(*(b[3] for b in x)) & set().union(*(b[3] for b in y))
    ids = {k: i for i, k in enumerate(there)}
    weight = np.array([k[2] for k in ids], np.int64)
    left, right = _Side(x, ids), _Side(y, ids)
    m, n = len(x), len(y)

    def gain(i: int, di: int, dj: int, j0: int, j1: int) -> np.ndarray:
        """What di sentences from i on have in common with dj from each j in j0 .. j1 - 1 on."""
        ends = right.ends[dj][j0 : j1 + 1]
        at = slice(ends[0], ends[-1])
        k = right.ids[dj][at]
        shared = np.minimum(left.row(di, i, len(ids))[k], right.counts[dj][at]) * weight[k]
        upto = np.concatenate(([0], np.cumsum(shared)))[ends - ends[0]]
        return np.diff(upto) + f.characters * np.minimum(left.chars[di][i], right.chars[dj][j0:j1])

    share = lambda chars: np.concatenate(([0.0], np.cumsum(chars) / max(1, chars.sum())))
    centre = np.searchsorted(share(right.chars[1]), share(left.chars[1]) - 1e-12)
    lows, rows, steps = [], [], []

    def band(i: int, j0: int, j1: int) -> np.ndarray:
        """Row i from j0 to j1 - 1; LOST outside its band."""
        out = np.full(j1 - j0, LOST, np.int64)
        if i >= 0:
            a, b = max(j0, lows[i]), min(j1, lows[i] + len(rows[i]))
            if a < b:
                out[a - j0 : b - j0] = rows[i][a - lows[i] : b - lows[i]]
        return out

    for i in range(m + 1):
        lo, hi = max(0, int(centre[i]) - f.beam), min(n, int(centre[i]) + f.beam)
        if i:
            lo = min(lo, lows[-1] + len(rows[-1]) - 1)
        if i == m:
            hi = n
        width = hi - lo + 1
        found = np.full((len(STEPS), width), LOST, np.int64)
        if i == 0:
            found[1, 0] = 0
        for s, (di, dj) in enumerate(STEPS):
            if (di, dj) == (0, 1) or i < di:
                continue
            found[s] = band(i - di, lo - dj, hi - dj + 1)
            if di and dj:
                a, b = max(lo - dj, 0), min(hi - dj, n - dj) + 1
                if a < b:
                    found[s, a - lo + dj : b - lo + dj] += gain(i - di, di, dj, a, b)
                found[s, : max(0, a - lo + dj)] = LOST
        best = np.maximum.accumulate(found.max(axis=0))
        # a step along the row keeps the value of its left neighbour
        found[1, 1:] = np.maximum(found[1, 1:], best[:-1])
        lows.append(lo)
        rows.append(best)
        steps.append((found == best).argmax(axis=0).astype(np.int8))
    out, i, j = [], m, n
    while i or j:
        di, dj = STEPS[steps[i][j - lows[i]]]
        value = int(rows[i][j - lows[i]])
        i, j = i - di, j - dj
        quality = value - int(rows[i][j - lows[i]])
        if di == dj == 2:
            one, two = int(gain(i, 1, 1, j, j + 1)[0]), int(gain(i + 1, 1, 1, j + 1, j + 2)[0])
            if quality <= f.split * (one + two):
                out += [(i + 1, 1, j + 1, 1, two), (i, 1, j, 1, one)]
                continue
        out.append((i, di, j, dj, quality))

    def edge(side: list, at: int, d: int) -> tuple[int, int]:
        if d:
            return side[at][0], side[at + d - 1][1]
        start = side[at][0] if at < len(side) else side[-1][1] + 1
        return start, start - 1

    return [(*edge(x, i, di), *edge(y, j, dj), f"{di}:{dj}", quality) for i, di, j, dj, quality in reversed(out)]
