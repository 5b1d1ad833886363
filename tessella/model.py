"""Corpora, regions and results, all as DataFrames keyed by corpus."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ranges import flag_columns
from tessella.operators.skew import running_sum
from tessella.session import cut, cut_buckets

BLOCK = 50_000
HALO = 1_024

RESULT = ("corpus", "match", "matchend", "target", "keyword", "sort_rank")


@dataclass(frozen=True)
class Corpus:
    """``tokens``: corpus, cpos, one string column per p-attribute, region columns per s-attribute.
    ``regions``: corpus, satt, struc, start, end, value. ``beads``: source, target, bead, s1, s2, t1, t2.

    A Corpus may hold several corpora; every operator works on all of them at
    once, by the ``corpus`` column. Intervals are inclusive at both ends.
    """

    tokens: DataFrame
    regions: DataFrame
    patts: tuple[str, ...]
    satts: tuple[str, ...]
    beads: DataFrame | None = None
    properties: dict[str, str] = field(default_factory=dict)
    functions: dict[str, object] = field(default_factory=dict)  # dynamic attributes: names of functions from columns to a column
    blocks: DataFrame | None = None  # tokens by block as ``blocked`` gives them, stored in buckets of (corpus, _block)
    longest: dict[str, int] = field(default_factory=dict)  # words of the longest region of each s-attribute, where known
    bare: DataFrame | None = None  # tokens without regions, as ``build`` got them

    @classmethod
    def build(cls, tokens: DataFrame, regions: DataFrame | None, patts: tuple[str, ...], satts: tuple[str, ...] = (), beads: DataFrame | None = None, properties: dict[str, str] | None = None) -> Corpus:
        """Denormalise the regions onto the tokens."""
        if regions is None:
            regions = tokens.sparkSession.createDataFrame([], "corpus string, satt string, struc bigint, start bigint, end bigint, value string")
        bare = tokens.select("corpus", "cpos", *patts)
        flagged = flag_columns(bare.withColumn("_block", F.floor(F.col("cpos") / BLOCK)), regions, list(satts), BLOCK).drop("_block")
        return cls(flagged, regions, tuple(patts), tuple(satts), beads, dict(properties or {}), bare=bare)

    def only(self, name: str) -> Corpus:
        c = F.col("corpus") == name
        return replace(self, tokens=self.tokens.filter(c), regions=self.regions.filter(c), blocks=None if self.blocks is None else self.blocks.filter(c), bare=None if self.bare is None else self.bare.filter(c))

    def blocked(self, width: int) -> DataFrame:
        """Tokens with ``_block``, a run of positions, and ``_own``: false for what is repeated of its neighbours.

        The first ``width`` tokens of a block end the one before as well, and its
        last token begins the next one, so windows by (corpus, _block) see all
        that a match from an own token may reach. Stored blocks serve widths up to HALO without a shuffle.
        """
        if self.blocks is not None and width <= HALO:
            return self.blocks
        return _halo(self.tokens, width)

    def stored(self, name: str) -> Corpus:
        """The corpus as tables in the shared folder: tokens in blocks, hashed and sorted by (corpus, _block), regions, beads."""
        regions = cut(self.regions, f"{name}-regions")

        fresh = self.bare is not None and bool(self.satts)
        rows = flag_columns(_halo(self.bare, HALO), regions, list(self.satts), BLOCK, 1, HALO) if fresh else _halo(self.tokens, HALO)
        blocks = cut_buckets(rows, ["corpus", "_block"], ["corpus", "_block", "cpos"], name, partitioned=fresh)
        longest = {r.satt: r.n for r in regions.groupBy("satt").agg(F.max(F.col("end") - F.col("start") + 1).alias("n")).collect()}  # one row an attribute
        return replace(self, tokens=blocks.filter("_own").drop("_block", "_own"), regions=regions, beads=None if self.beads is None else cut(self.beads, f"{name}-beads"), bare=None, blocks=blocks, longest={s: longest.get(s, 0) for s in self.satts})

    def size(self) -> DataFrame:
        """(corpus, size): one more than the last position."""
        return self.tokens.groupBy("corpus").agg((F.max("cpos") + 1).alias("size"))

    def lexicon(self, att: str) -> DataFrame:
        """(corpus, id, <att>, freq): ids in order of first occurrence, from 0. Numbered by distributed prefix sums."""
        types = self.tokens.groupBy("corpus", att).agg(F.count("*").alias("freq"), F.min("cpos").alias("_first"))
        numbered = running_sum(types.withColumn("_one", F.lit(1).cast("long")), ["corpus"], ["_first"], "_one", "_upto")
        return numbered.select("corpus", (F.col("_upto") - 1).alias("id"), att, "freq")


def _halo(tokens: DataFrame, width: int) -> DataFrame:
    size = max(BLOCK, width)
    own = F.floor(F.col("cpos") / size)
    at = F.col("cpos") - own * size
    blocks = F.array_compact(F.array(F.when((at < width) & (own > 0), own - 1), own, F.when(at == size - 1, own + 1)))
    return tokens.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)


def result(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of a result; anchors that it lacks are null."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("long").alias(c) for c in RESULT])
