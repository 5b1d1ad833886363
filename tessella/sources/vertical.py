"""Ingest of vertical text: token lines and tag lines to tokens and regions; checks; exports."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.featuresets import make_set
from tessella.functions.scalar import entity_decode
from tessella.operators.skew import running_sum

BLOCK = 1 << 16


@dataclass(frozen=True)
class Structure:
    """An s-attribute declaration: nesting depth, attributes split off, whether the tag's text is its value."""

    name: str
    depth: int = 0
    attributes: tuple[str, ...] = ()
    valued: bool = False

    @classmethod
    def parse(cls, text: str, valued: bool = False) -> Structure:
        """``name[:depth][+a[/]...]``"""
        head, *attrs = text.split("+")
        name, _, depth = head.partition(":")
        return cls(name, int(depth or 0), tuple(a.rstrip("/") for a in attrs), valued)


def read_files(spark: SparkSession, path: str, corpus: str, charset: str = "utf-8", invalid: str = "error") -> DataFrame:
    """(corpus, file, line_no, raw) of text files, compressed ones included; files are put in byte order of their names.

    A large file is read by many tasks, as Spark splits it. A line's place is its split's first byte and its
    turn within the split; places are made numbers from 0 per file by prefix sums over range partitions.
    A byte order mark at the beginning and carriage returns at the ends of lines are taken off. ``charset`` names the
    encoding (UTF-8, or one the JVM decodes). Bytes that aren't valid UTF-8 are an error when the lines are read
    (``invalid="error"``), become U+FFFD (``"repair"``), or stay for ``check_lines`` to report (``"keep"``).
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_turn"), F.col("value"))
    if charset.lower().replace("-", "") != "utf8":
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), charset))
    elif invalid == "repair":
        lines = lines.withColumn("value", F.make_valid_utf8("value"))
    elif invalid == "error":
        lines = lines.withColumn("value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "file")).cast("string")))
    numbered = running_sum(lines.withColumn("_one", F.lit(1).cast("long")), ["file"], ["_at", "_turn"], "_one", "_n")
    # by bytes, which leaves invalid ones as they are
    whole = F.when((F.col("_n") == 1) & F.col("value").startswith("\ufeff"), _bytes("value", F.lit(4), F.octet_length("value") - 3)).otherwise(F.col("value"))
    numbered = numbered.withColumn("value", whole)
    raw = F.when(F.col("value").endswith("\r"), _bytes("value", F.lit(1), F.octet_length("value") - 1)).otherwise(F.col("value"))
    return numbered.select(F.lit(corpus).alias("corpus"), "file", (F.col("_n") - 1).alias("line_no"), raw.alias("raw"))


def _bytes(c: str, start: Column, n: Column) -> Column:
    return F.substr(F.col(c).cast("binary"), start, n).cast("string")


def next_in_order(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row that follows in the key, null for the last.

    ``order`` is a distinct long. Windows run within blocks of it; the last row of
    a block looks at the first row of the next block that has one, so a key that holds
    most rows is no single task.
    """
    rows = df.withColumns({"_nb": F.floor(F.col(order) / BLOCK), "_nv": value})
    w = Window.partitionBy(*keys, "_nb").orderBy(order)
    firsts = rows.groupBy(*keys, "_nb").agg(F.min_by("_nv", order).alias("_nf"))
    after = firsts.withColumn("_na", F.lead("_nf").over(Window.partitionBy(*keys).orderBy("_nb"))).drop("_nf")
    local = rows.withColumns({"_nl": F.lead("_nv").over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    on = ["_nb", *keys]
    return local.join(after, on).withColumn(out, F.when(F.col("_last"), F.col("_na")).otherwise(F.col("_nl"))).drop("_nb", "_nv", "_nl", "_last", "_na")


TAG = r"\A<(/?)([A-Za-z][\w.-]*)([^>]*?)(/?)>\s*\z"


def encode(lines: DataFrame, patts: Sequence[str], structures: Sequence[Structure] = (), null: Sequence[str] = (), undef: str = "__UNDEF__", strip: bool = False, entities: bool = False, sets: Sequence[str] = (), skip_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tokens, regions) of vertical text.

    ``lines`` has corpus, file, line_no, raw. Token lines give tokens(corpus, cpos, patts): missing and
    empty columns become ``undef``; ``strip`` takes blanks off, ``entities`` decodes the five XML ones,
    columns in ``sets`` are normalised as feature sets ("|" if malformed). Tags of ``structures`` give regions, those in ``null``
    nothing, any other is a token. A start tag closes an open region of its name
    (unless nesting is declared; deeper levels are named name1, name2..., beyond the depth dropped), a
    surplus end tag is ignored, an empty region dropped, and what is open at the end
    of the corpus closed there. Attributes ``a`` of a structure become regions name_a with
    their value, "" where the tag lacks it.

    Positions are a running count over range partitions in (file, line) order.
    """
    known = {s.name for s in structures}
    parts = lines.filter(F.col("raw").isNotNull()).withColumn("raw", F.trim("raw") if strip else F.col("raw"))
    if skip_empty:
        parts = parts.filter("raw <> ''")
    name = F.regexp_extract("raw", TAG, 2)
    kind = F.when(F.col("raw").rlike(r"\A<[!?]"), "skip").when(name.isin(*null) if null else F.lit(False), "skip").when(name.isin(*known) if known else F.lit(False), "tag").otherwise("token")
    parts = parts.withColumns({"_kind": kind, "_name": name}).filter("_kind <> 'skip'").withColumn("_is", (F.col("_kind") == "token").cast("long"))
    placed = running_sum(parts.withColumn("_one", F.lit(1).cast("long")), ["corpus"], ["file", "line_no"], "_is", "_upto")
    placed = running_sum(placed, ["corpus"], ["file", "line_no"], "_one", "_ord")
    cells = F.split("raw", "\t", -1)

    def cell(i: int, att: str) -> Column:
        c = F.get(cells, F.lit(i))
        c = F.trim(c) if strip else c
        c = entity_decode(c) if entities else c
        if att in sets:
            return F.coalesce(make_set(c), F.lit("|"))
        return F.when(c.isNull() | (c == ""), F.lit(undef)).otherwise(c)

    tokens = placed.filter("_kind = 'token'").select("corpus", (F.col("_upto") - 1).alias("cpos"), *[cell(i, a).alias(a) for i, a in enumerate(patts)])
    size = placed.groupBy("corpus").agg(F.max("_upto").alias("_size"))
    tags = placed.filter("_kind = 'tag'").select("corpus", "_ord", F.col("_upto").alias("_at"), "_name", (F.regexp_extract("raw", TAG, 1) == "").alias("_open"), F.trim(F.regexp_extract("raw", TAG, 3)).alias("_attrs"))
    depth = {s.name: s.depth for s in structures}
    nested = [n for n, d in depth.items() if d > 0]
    flat_tags = tags.filter(~F.col("_name").isin(nested)) if nested else tags
    events = flat_tags.withColumn("_level", F.lit(0).cast("long"))
    if nested:
        deep = tags.filter(F.col("_name").isin(nested)).withColumn("_step", F.when(F.col("_open"), 1).otherwise(-1).cast("long"))
        deep = running_sum(deep, ["corpus", "_name"], ["_ord"], "_step", "_level")
        # an end tag belongs to the level it leaves
        events = events.unionByName(deep.withColumn("_level", F.when(F.col("_open"), F.col("_level") - 1).otherwise(F.col("_level"))).drop("_step").select(events.columns))
    closed = next_in_order(events, ["corpus", "_name", "_level"], "_ord", F.col("_at"), "_next").filter("_open").join(size, "corpus")
    spans = closed.select("corpus", "_name", "_level", "_attrs", F.col("_at").alias("start"), (F.coalesce("_next", "_size") - 1).alias("end")).filter("start <= end and _level >= 0")
    limit = F.lit(None).cast("int")
    for n, d in depth.items():
        limit = F.when(F.col("_name") == n, F.lit(d)).otherwise(limit)
    spans = spans.filter(F.col("_level") <= limit)
    satt = F.when(F.col("_level") == 0, F.col("_name")).otherwise(F.concat(F.col("_name"), F.col("_level").cast("string")))
    valued = [s.name for s in structures if s.valued]
    value = F.when(F.col("_name").isin(*valued), entity_decode(F.col("_attrs")) if entities else F.col("_attrs")) if valued else F.lit(None).cast("string")
    out = spans.select("corpus", satt.alias("satt"), "start", "end", value.alias("value"))
    for s in structures:
        for a in s.attributes:
            v = F.coalesce(*[F.nullif(F.regexp_extract("_attrs", rf"(?:^|\s){a}\s*=\s*{q}", 1), F.lit("")) for q in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")], F.lit(""))
            level = F.when(F.col("_level") == 0, F.lit("")).otherwise(F.col("_level").cast("string"))
            out = out.unionByName(spans.filter(F.col("_name") == s.name).select("corpus", F.concat(F.lit(f"{s.name}_{a}"), level).alias("satt"), "start", "end", entity_decode(v).alias("value")))
    return tokens, numbered_regions(out)


def numbered_regions(regions: DataFrame) -> DataFrame:
    """Regions with ``struc``, their 0-based number per corpus and attribute."""
    one = regions.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, ["corpus", "satt"], ["start", "end"], "_one", "struc").withColumn("struc", F.col("struc") - 1).select("corpus", "satt", "struc", "start", "end", "value")


def import_regions(rows: DataFrame, satt: str, overlap: str = "strict") -> DataFrame:
    """Regions from (corpus, start, end, value[, line]).

    ``strict`` wants them ascending and without overlap; anything else is an error when the regions
    are computed. ``merge`` takes them one by one in the order of ``line`` (without it, of start,
    end, value): one that starts within a region there already is dropped, unless
    it starts with it and is at least as long, and then replaces it; regions that a new
    one reaches into go. Inverted ones are dropped first.

    Only regions that overlap, directly or through others, can matter to each
    other; these clusters are found by windows over blocks and folded in their own order.
    """
    if overlap == "strict":
        follows = next_in_order(rows, ["corpus"], "start", F.col("start"), "_next")
        what = F.concat(F.lit("inverted or overlapping region: "), F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string"))
        good = (F.col("start") <= F.col("end")) & F.coalesce(F.col("_next") > F.col("end"), F.lit(True))
        kept = follows.withColumn("start", F.when(good, F.col("start")).otherwise(F.raise_error(what).cast("long")))
    else:
        from tessella.operators.intervals import clusters

        order = F.col("line").cast("long") if "line" in rows.columns else F.lit(0).cast("long")
        spans = rows.filter("start <= end").select("corpus", F.col("start").alias("match"), F.col("end").alias("matchend"), "value", order.alias("line"))
        kept = clusters(spans).select("corpus", "_cluster", "match", "matchend", "value", "line").groupBy("corpus", "_cluster").applyInArrow(lambda t: _inserted(t), "corpus string, start bigint, end bigint, value string")
    return numbered_regions(kept.select("corpus", F.lit(satt).alias("satt"), "start", "end", "value"))


def _inserted(table: pa.Table) -> pa.Table:
    rows = table.sort_by([("line", "ascending"), ("match", "ascending"), ("matchend", "ascending"), ("value", "ascending")])
    starts: list[int] = []  # of what is kept, ascending
    kept: dict[int, tuple[int, str | None]] = {}
    for s, e, v in zip(*(rows[c].to_pylist() for c in ("match", "matchend", "value")), strict=True):
        k = bisect_right(starts, s)
        if k and s <= kept[starts[k - 1]][0]:
            if starts[k - 1] < s or kept[s][0] > e:
                continue
        else:
            starts.insert(k, s)
            k += 1
        kept[s] = (e, v)
        gone = bisect_right(starts, e)
        del starts[k:gone]
    return pa.table([pa.array([table["corpus"][0].as_py()] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array([kept[s][0] for s in starts], pa.int64()), pa.array([kept[s][1] for s in starts], pa.string())], names=["corpus", "start", "end", "value"])


def export_regions(regions: DataFrame, satt: str, values: bool = True) -> DataFrame:
    """(corpus, line): ``start TAB end [TAB value]``."""
    cells = [F.col("start").cast("string"), F.col("end").cast("string")] + ([F.col("value")] if values else [])
    return regions.filter(F.col("satt") == satt).select("corpus", "start", F.concat_ws("\t", *cells).alias("line"))


def import_beads(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """Beads from (source, target, s1, s2, t1, t2): those with an empty side are skipped, ``reverse`` swaps the sides."""
    rows = rows.filter("s2 >= s1 and t2 >= t1")
    if reverse:
        rows = rows.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("t1").alias("s1"), F.col("t2").alias("s2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    one = rows.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, ["source", "target"], ["s1", "s2"], "_one", "bead").withColumn("bead", F.col("bead") - 1).select("source", "target", "bead", "s1", "s2", "t1", "t2")


def check_lines(lines: DataFrame, columns: int | None = None) -> DataFrame:
    """(corpus, file, line_no, problem): empty lines, invalid UTF-8, CR ends, leading blanks, malformed tags, other column counts, unbalanced and crossing tags.

    ``columns`` is the wanted number; without it the most frequent one of the corpus. Tags nest if an end tag meets, as the
    last tag of its level, the start tag of its name: ``crossing``, at the end tag, tells of one that doesn't, ``surplus``
    of one that nothing opened. Levels are prefix sums over range partitions. A tag that stays open is ``unbalanced``.
    """
    raw = F.col("raw")
    tag = raw.rlike(r"\A<(?:/?[A-Za-z]|[!?])")
    n = F.size(F.split(raw, "\t", -1))
    rows = lines.withColumn("_n", F.when(~tag & (raw != ""), n))
    if columns is None:
        usual = rows.filter("_n is not null").groupBy("corpus", "_n").agg(F.count("*").alias("_c")).groupBy("corpus").agg(F.max_by("_n", F.struct("_c", -F.col("_n"))).alias("_want"))
        rows = rows.join(usual, "corpus", "left")
    else:
        rows = rows.withColumn("_want", F.lit(columns))
    problem = (
        F.when(raw.isNull() | (raw == ""), "empty").when(~F.is_valid_utf8(raw), "encoding").when(raw.endswith("\r"), "carriage_return").when(raw.rlike(r"\A\s"), "leading_blank")
        .when(tag & ~raw.rlike(r"\A<[!?]") & ~raw.rlike(r"\A</?[A-Za-z][\w.-]*(?:\s+[\w.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*/?>\s*\z"), "tag")
        .when(F.col("_n") != F.col("_want"), "columns")
    )
    found = rows.select("corpus", "file", "line_no", problem.alias("problem")).filter("problem is not null")
    tags = rows.filter(tag & raw.rlike(r"\A</?[A-Za-z]") & ~raw.rlike(r"/>\s*\z")).select("corpus", "file", "line_no", F.regexp_extract("raw", r"\A</?([A-Za-z][\w.-]*)", 1).alias("_name"), F.when(raw.startswith("</"), -1).otherwise(1).cast("long").alias("_step"))
    level = running_sum(tags, ["corpus", "file"], ["line_no"], "_step", "_level").withColumn("_level", F.when(F.col("_step") == 1, F.col("_level") - 1).otherwise(F.col("_level")))
    # of tags on one level, each start tag is followed by its end tag
    after = next_in_order(level, ["corpus", "file", "_level"], "line_no", F.struct("_step", "_name", "line_no"), "_next")
    fits = (F.col("_next._step") == -1) & (F.col("_next._name") == F.col("_name"))
    crossing = after.filter((F.col("_step") == 1) & F.col("_next").isNotNull() & ~fits).select("corpus", "file", F.col("_next.line_no").alias("line_no"), F.concat(F.lit("crossing "), "_next._name").alias("problem"))
    # an end tag that begins a level, or follows another one on it, ends nothing
    first = level.groupBy("corpus", "file", "_level").agg(F.min_by(F.struct("_step", "_name", "line_no"), "line_no").alias("_next"))
    ends = after.filter("_step = -1").select("corpus", "file", "_next").unionByName(first.select("corpus", "file", "_next")).filter("_next._step = -1")
    surplus = ends.select("corpus", "file", F.col("_next.line_no").alias("line_no"), F.concat(F.lit("surplus "), "_next._name").alias("problem"))
    unbalanced = tags.groupBy("corpus", "file", "_name").agg(F.sum("_step").alias("_s")).filter("_s <> 0").select("corpus", "file", F.lit(None).cast("long").alias("line_no"), F.concat(F.lit("unbalanced "), F.col("_name")).alias("problem"))
    return found.unionByName(crossing).unionByName(surplus).unionByName(unbalanced)


def read_beads(lines: DataFrame, target: str) -> DataFrame:
    """Beads from (corpus, file, line_no, raw) of alignment files: ``s1 s2 t1 t2`` by blanks or tabs, further columns ignored.

    Lines that don't begin with a digit (the header) are skipped, as are beads with an empty side. Source
    regions must ascend without overlap; anything else is an error when the beads are computed.
    """
    cells = F.split(F.trim("raw"), "\\s+")
    at = [F.get(cells, F.lit(k)).try_cast("long").alias(c) for k, c in enumerate(("s1", "s2", "t1", "t2"))]
    rows = lines.filter(F.col("raw").rlike(r"\A\s*\d")).select(F.col("corpus").alias("source"), F.lit(target).alias("target"), "file", "line_no", *at)
    after = next_in_order(rows, ["source", "file"], "line_no", F.col("s1"), "_next")
    good = (F.col("s1").isNotNull() & F.col("t2").isNotNull()) & F.coalesce(F.col("_next") > F.col("s2"), F.lit(True))
    what = F.concat(F.lit("source regions must ascend: line "), F.col("line_no").cast("string"))
    return import_beads(after.withColumn("s1", F.when(good, F.col("s1")).otherwise(F.raise_error(what).cast("long"))).select("source", "target", "s1", "s2", "t1", "t2"))


def check_pre_alignment(source: "Corpus", target: "Corpus", satt: str, pre: str) -> DataFrame:  # noqa: F821
    """(corpus, pair, struc, problem): what keeps regions of ``pre`` from aligning sentences pair by pair.

    ``count``: the corpora have different numbers of them; ``partition``: a region doesn't begin or end with
    one of ``satt``. Empty if all is well.
    """
    out = None
    for c, other in ((source, target), (target, source)):
        of = c.regions.filter(F.col("satt") == pre)
        inner = c.regions.filter(F.col("satt") == satt)
        edges = of.join(inner.select("corpus", "start", F.lit(True).alias("_a")), ["corpus", "start"], "left").join(inner.select("corpus", "end", F.lit(True).alias("_z")), ["corpus", "end"], "left")
        bad = edges.filter("_a is null or _z is null").select("corpus", F.lit(None).cast("string").alias("pair"), "struc", F.lit("partition").alias("problem"))
        mine = of.groupBy("corpus").agg(F.count("*").alias("_n"))
        theirs = other.regions.filter(F.col("satt") == pre).groupBy(F.col("corpus").alias("pair")).agg(F.count("*").alias("_m"))
        uneven = mine.join(theirs, F.col("corpus") != F.col("pair")).filter("_n <> _m").select("corpus", "pair", F.lit(None).cast("long").alias("struc"), F.lit("count").alias("problem"))
        both = bad.unionByName(uneven)
        out = both if out is None else out.unionByName(both)
    return out.distinct()


