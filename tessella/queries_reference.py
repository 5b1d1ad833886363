"""Queries of the corpus operators over the driver's tables, each with SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import featuresets, scalar
from tessella.functions.folding import fold
from tessella.model import Corpus, result
from tessella.operators import access, alignment, cooccur, display, frequency, intervals, refine, sequence
from tessella.operators.aligner import align
from tessella.plans.language import Parser, parse
from tessella.sources import vertical

_BUILT: dict[tuple[str, str, str], Corpus] = {}


def _kept(spark: SparkSession, d: str, kind: str, build: Callable[[], Corpus]) -> Corpus:
    """A corpus is built once a session and kept as a table; its queries read it like any stored corpus."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _BUILT:
        _BUILT[key] = build().stored(kind)
    return _BUILT[key]


def text_corpus(spark: SparkSession, d: str) -> Corpus:
    """tokens and regions, each position and region once; texts of equal number are aligned between neighbouring corpora."""

    def build() -> Corpus:
        t = spark.read.parquet(f"{d}/tokens.parquet")
        defined = lambda c: F.coalesce(F.max(F.nullif(c, F.lit("__UNDEF__"))), F.lit("__UNDEF__")).alias(c)
        tokens = t.groupBy("corpus", "cpos").agg(F.max("word").alias("word"), defined("pos"), defined("lemma"))
        r = spark.read.parquet(f"{d}/regions.parquet").filter("start_cpos <= end_cpos")
        regions = r.groupBy("corpus", "satt", "struc").agg(F.min("start_cpos").alias("start"), F.max("end_cpos").alias("end"), F.max("region_value").alias("value"))
        first = regions.filter("satt = 'text'").groupBy("corpus").agg(F.min("struc").alias("_first"))
        texts = regions.filter("satt = 'text'").join(first, "corpus").withColumn("struc", F.col("struc") - F.col("_first"))
        w = Window.orderBy("corpus")
        names = regions.select("corpus").distinct().select("corpus", F.lead("corpus").over(w).alias("_other")).filter("_other is not null")
        s = texts.join(names, "corpus").select(F.col("corpus").alias("source"), F.col("_other").alias("target"), "struc", F.col("start").alias("s1"), F.col("end").alias("s2"))
        beads = s.join(texts.select(F.col("corpus").alias("target"), "struc", F.col("start").alias("t1"), F.col("end").alias("t2")), ["target", "struc"]).select("source", "target", F.col("struc").alias("bead"), "s1", "s2", "t1", "t2")
        return Corpus.build(tokens, regions, ("word", "pos", "lemma"), ("s", "text"), beads)

    return _kept(spark, d, "texts", build)


def event_corpus(spark: SparkSession, d: str) -> Corpus:
    """Each user's events in time order as a corpus of its own."""

    def build() -> Corpus:
        e = spark.read.parquet(f"{d}/events.parquet")
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        tokens = e.select(F.col("user_id").cast("string").alias("corpus"), (F.row_number().over(w) - 1).cast("long").alias("cpos"), F.col("event_type").alias("word"))
        return Corpus.build(tokens, None, ("word",))

    return _kept(spark, d, "events", build)


def _iv(df: DataFrame) -> DataFrame:
    return df.select("corpus", "match", "matchend")


def _ask(text: str, strategy: str = "standard", build: Callable = text_corpus) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _iv(sequence.run(build(spark, d), parse(text), strategy=strategy))


def _with(f: Callable[[Corpus], DataFrame], build: Callable = text_corpus) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(build(spark, d))


def _find(c: Corpus, text: str, strategy: str = "standard") -> DataFrame:
    return sequence.run(c, parse(text), strategy=strategy)


def _test(text: str) -> object:
    return Parser(text)._token().test


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    c = text_corpus(spark, d)
    return align(c, c, "s", "text", corpora=c.beads)


def _rare(spark: SparkSession, d: str) -> DataFrame:
    """A loop that nearly no block satisfies, in corpora of which one has no hit at all."""
    c = text_corpus(spark, d)
    names = c.tokens.select("corpus").distinct()
    pad = names.select(F.concat(F.lit("PAD_"), "corpus").alias("corpus"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("cpos"), F.lit("pad").alias("word"), F.lit("Z").alias("pos"), F.lit("pad").alias("lemma"))
    both = Corpus.build(c.tokens.select("corpus", "cpos", "word", "pos", "lemma").unionByName(pad), c.regions, c.patts, ("s",))
    return _iv(sequence.run(both, parse('[pos="C"]+ [pos="X"] within s'), strategy="traditional"))


def _sample(c: Corpus) -> DataFrame:
    """Of a sample: its size, its distinct rows, and how many of these are rows of the result it was drawn from."""
    nouns = _find(c, NOUNS)
    rows = refine.reduce(nouns, percent=30, seed=3).select("corpus", "match", "matchend")
    there = rows.join(nouns.select("corpus", "match", "matchend").distinct().withColumn("_there", F.lit(1)), ["corpus", "match", "matchend"], "left")
    return there.groupBy("corpus").agg(F.count("*").alias("size"), F.count_distinct("match", "matchend").alias("distinct_rows"), F.count("_there").alias("of_result"))


def _shown(c: Corpus) -> DataFrame:
    view = display.View(1, 1, "word", "word", ("word", "pos"), ("s",), targets=True, structures=("text",))
    found = _find(c, '@[pos="X"]')
    return display.concordance(c, found.unionByName(found), view).select("corpus", "line_no", "match", "structures", "left_context", "node", "right_context")


def _merged(c: Corpus) -> DataFrame:
    """Overlapping intervals, in an order that isn't theirs, as regions."""
    line = (F.col("match") * 7919 + F.col("matchend") * 104729) % 1000003
    rows = _mixed(c).select("corpus", F.col("match").alias("start"), F.col("matchend").alias("end"), F.lit(None).cast("string").alias("value"), line.alias("line"))
    return vertical.import_regions(rows, "m", "merge").select("corpus", "struc", "start", "end")


NP = '[pos="D"]? [pos="A"]? [pos="N"] within s'
NOUNS = '[pos="N"]'


def _mixed(c: Corpus) -> DataFrame:
    """Overlapping and nested intervals: words after a determiner up to a noun, and runs around verbs."""
    a = _find(c, '[pos="D"] []{0,3} [pos="N"]', "traditional")
    b = _find(c, '[] [pos="V"] []', "traditional")
    return intervals.union(a, b)


def _targets(c: Corpus) -> DataFrame:
    return refine.set_anchor_search(c, _find(c, NOUNS), "target", "nearest", _test('[pos="D"]'), 3)


def _features(spark: SparkSession, d: str) -> DataFrame:
    r = spark.read.parquet(f"{d}/region_items.parquet")
    lex = spark.read.parquet(f"{d}/lexicon.parquet").filter("att = 'category'").select(F.col("name").alias("_name"), F.col("id").alias("_id"))
    # few items come by name only; those with an id don't go into the join
    named = r.filter("id is null and name is not null").drop("id").join(lex, F.lower(F.trim("name")) == F.col("_name")).select("corpus", "text_id", F.col("_id").alias("id"))
    r = r.filter("id is not null").select("corpus", "text_id", "id").unionByName(named)
    sets = r.groupBy("corpus", "text_id").agg(F.concat(F.lit("|"), F.array_join(F.sort_array(F.collect_set(F.col("id").cast("string"))), "|"), F.lit("|")).alias("s"))
    other = F.lit("|3000|3001|3002|3003|3004|")
    return sets.select("corpus", "text_id", featuresets.set_size(F.col("s")).alias("n"), featuresets.set_intersection(F.col("s"), other).alias("common"), featuresets.ambiguity(featuresets.unify(F.col("s"), other)).alias("k"))


def _scalars(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lexicon.parquet").filter("att = 'word'")
    n = F.col("name")
    return x.select("id", scalar.prefix(n, F.lit("treerish")).alias("prefix"), scalar.minus(n, F.lit("tree")).alias("minus"), scalar.is_prefix(F.lit("tr"), n).alias("is_prefix"), scalar.to_int(F.col("name_len").cast("string")).alias("number"), F.reverse(n).alias("reversed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "seq_bigram": _ask('[pos="A"] [pos="N"] within s'),
    "seq_np_traditional": _ask(NP, "traditional"),
    "seq_np_standard": _ask(NP, "standard"),
    "seq_np_shortest": _ask(NP, "shortest"),
    "seq_np_longest": _ask(NP, "longest"),
    "seq_run_longest": _ask('[pos="A"]+ [pos="N"] within s', "longest"),
    "seq_label": _ask('a:[pos="N"] []{0,3} [lemma = a.lemma] within s', "traditional"),
    "seq_constraint": _ask('a:[pos="D"] []{0,4} b:[pos="N"] :: dist(a,b) = 2 within s', "traditional"),
    "seq_start_tag": _ask('<s> [pos="D"] []', "traditional"),
    "seq_end_tag": _ask('[pos!="P"] [] </s>', "traditional"),
    "seq_rare": _rare,
    "seq_label_regex": lambda spark, d: _iv(sequence.run(text_corpus(spark, d), parse('a:[pos="N"] [pos!="N"]* [pos="N" & lemma = RE($v) & word != a.word] within s'), {"v": {"tr.*", ".*ist", "s.n.*"}}, "traditional")),
    "seq_np_target": _with(lambda c: _find(c, 'a:[pos="D"] @[pos="A"]? @1[pos="N"] :: match.lemma != "zzz" & a.pos = "D" within s', "traditional").select("corpus", "match", "matchend", F.coalesce("target", F.lit(-1).cast("long")).alias("target"), "keyword")),
    "seq_lookahead": _ask('[pos="N"] [: pos="V" :]', "traditional"),
    "seq_regex_case": _ask('"TR.*"%c within s'),
    "seq_regex_diacritics": _ask('".*a.*e.*"%d within s'),
    "seq_frequency": _ask("[f(lemma) >= 50 & pos = \"V\"]"),
    "seq_region_value": _ask('[pos="N" & _.text = "B.*"]'),
    "seq_within_words": _ask('[pos="D"] [pos!="N"]* [pos="N"] within 4', "traditional"),
    "seq_events": _ask('"view" "click" "purchase"', "traditional", event_corpus),
    "seq_events_gap": _ask('"view" [word!="purchase"]{0,3} "purchase"', "traditional", event_corpus),
    "mu_window": _with(lambda c: _iv(cooccur.run_mu(c, parse('MU(meet [pos="N"] [pos="V"] -3 2)')))),
    "mu_region": _with(lambda c: _iv(cooccur.run_mu(c, parse('MU(meet [pos="X"] [pos="C"] s)')))),
    "mu_nested": _with(lambda c: _iv(cooccur.run_mu(c, parse('MU(union (meet [pos="X"] [pos="N"] -1 1) (meet [pos="C"] [pos="V"]))')))),
    "tab_gaps": _with(lambda c: _iv(cooccur.run_tab(c, parse('TAB [pos="D"] {,2} [pos="N"] * [pos="V"] within s')))),
    "set_union": _with(lambda c: _iv(intervals.union(_find(c, NP), _find(c, NOUNS)))),
    "set_intersection": _with(lambda c: _iv(intervals.intersection(_find(c, NP), _find(c, NOUNS)))),
    "set_difference": _with(lambda c: _iv(intervals.difference(_find(c, NP), _find(c, NOUNS)))),
    "prune_minimal": _with(lambda c: _iv(intervals.minimal(_mixed(c)))),
    "prune_maximal": _with(lambda c: _iv(intervals.maximal(_mixed(c)))),
    "prune_left_maximal": _with(lambda c: _iv(intervals.left_maximal(_mixed(c)))),
    "prune_non_overlapping": _with(lambda c: _iv(intervals.non_overlapping(_mixed(c)))),
    "keep_containing": _with(lambda c: _iv(intervals.containing(refine.expand(c, _find(c, NOUNS), 1, "s"), _find(c, '[pos="X"]')))),
    "subquery": _with(lambda c: _iv(sequence.run(c, parse('[pos="V"]'), parents=_find(c, '[pos="D"] []{1,3} [pos="N"]')))),
    "expand_region": _with(lambda c: _iv(refine.expand(c, _find(c, '[pos="X"]'), 1, "s"))),
    "expand_words": _with(lambda c: _iv(refine.expand(c, _find(c, '[pos="X"]'), 2, None, "left"))),
    "subset_anchor": _with(lambda c: _iv(refine.subset(c, _find(c, NP), "match", _test('[pos="D"]')))),
    "anchor_nearest": _with(lambda c: _targets(c).select("corpus", "match", "matchend", F.coalesce("target", F.lit(-1).cast("long")).alias("target"))),
    "anchor_delete": _with(lambda c: _iv(refine.delete_by_anchor(_targets(c), "target", False))),
    "cut_rows": _with(lambda c: _iv(refine.cut(_find(c, NOUNS), 5, 9))),
    "delete_rows": _with(lambda c: _iv(refine.delete_lines(_find(c, NOUNS), 3, 40))),
    "delete_duplicates": _with(lambda c: _iv(refine.delete_lines(alignment.translate(_find(c, '[pos="X"]'), c.beads), 2, 30))),
    "regions_merge": _with(_merged),
    "size_rows": _with(lambda c: refine.size(_targets(c), "target")),
    "reduce_percent": _with(_sample),
    "scan_bigrams": _with(lambda c: frequency.scan(c, ["word+0", "word+1"])),
    "scan_trigrams_pos": _with(lambda c: frequency.scan(c, ["pos+0", "pos+1", "pos+2"], min_freq=2)),
    "scan_filtered": _with(lambda c: frequency.scan(c, ["lemma+0", "?pos+1=/V|N/", "?s+1"], min_freq=3)),
    "scan_region": _with(lambda c: frequency.scan(c, ["text", "pos"])),
    "lexicon_all": _with(lambda c: frequency.lexicon_export(c, "word")),
    "lexicon_regex": _with(lambda c: frequency.lexicon_export(c, "lemma", "tr.*|.*ist")),
    "lexicon_sizes": _with(lambda c: frequency.lexicon_sizes(c, "lemma")),
    "group_single": _with(lambda c: frequency.group(c, _find(c, NP), "matchend", "lemma", cut=2)),
    "group_pairs": _with(lambda c: frequency.group(c, _targets(c), "match", "pos", ("target", "word"))),
    "group_totals": _with(lambda c: frequency.grouped(c, _find(c, '[pos="A"] [pos="N"]'), "matchend", "lemma", ("match", "pos"), 2)),
    "count_spans": _with(lambda c: frequency.count(c, _find(c, '[pos="A"] [pos="N"]'), "lemma")),
    "sort_by_word": _with(lambda c: frequency.sort(c, _find(c, '[pos="X"]'), "word").select("corpus", "match", "sort_rank")),
    "tabulate": _with(lambda c: display.tabulate(c, _find(c, '[pos="A"] [pos="N"]'), [display.Item(frequency.Span(), "word"), display.single("match", "lemma", -1), display.single("matchend")]).select("corpus", "match", "item_0", "item_1", "item_2")),
    "kwic_words": _with(lambda c: display.kwic(c, _find(c, '[pos="X"]'), 2, 2, "word").select("corpus", "match", "left_context", "node", "right_context")),
    "kwic_attributes": _with(_shown),
    "dump_rows": _with(lambda c: display.dump(_targets(c))),
    "decode_lines": _with(lambda c: display.decode(c, ["word", "pos"])),
    "describe": _with(display.describe),
    "align_translate": _with(lambda c: _iv(alignment.translate(_find(c, '[pos="X"]'), c.beads))),
    "align_filter": _with(lambda c: _iv(alignment.aligned_filter(_find(c, '[pos="X"]'), c.beads, _find(c, '[pos="C"]')))),
    "align_filter_not": _with(lambda c: _iv(alignment.aligned_filter(_find(c, '[pos="X"]'), c.beads, _find(c, '[pos="C"]'), True))),
    "align_sentences": _sentences,
    "access_lexicon_ids": _with(lambda c: c.lexicon("lemma")),
    "access_sort_index": _with(lambda c: access.sort_index(c, "lemma")),
    "access_structures": _with(lambda c: access.cpos2struc(c, "s").filter("struc is not null").drop("value")),
    "boundary_flags": _with(lambda c: access.cpos2struc(c, "text").select("corpus", "cpos", "flags")),
    "feature_sets": _features,
    "scalar_functions": _scalars,
    "fold_case": lambda spark, d: spark.read.parquet(f"{d}/tokens.parquet").filter("word is not null").select(fold(F.col("word"), "d").alias("folded")).groupBy("folded").count().select("folded", F.col("count").alias("n")),
}

T = """
    with tk as materialized (select corpus, cpos, max(word) as word, coalesce(max(nullif(pos, '__UNDEF__')), '__UNDEF__') as pos,
                coalesce(max(nullif(lemma, '__UNDEF__')), '__UNDEF__') as lemma from tokens group by 1, 2),
    rg as materialized (select corpus, satt, struc, min(start_cpos) as s, max(end_cpos) as e, max(region_value) as v from regions
           where start_cpos <= end_cpos group by 1, 2, 3),
    sx as materialized (select corpus, struc, s, e from rg where satt = 's'),
    tt as materialized (select corpus, struc, s, e, v from rg where satt = 'text'),
    t as materialized (select tk.*, case when cpos <= sx.e then sx.struc end as s_id, case when cpos <= sx.e then sx.s end as s_start, case when cpos <= sx.e then sx.e end as s_end,
          case when cpos <= tt.e then tt.struc end as text_id, case when cpos <= tt.e then tt.v end as text_value
          from tk asof left join sx on sx.corpus = tk.corpus and sx.s <= tk.cpos asof left join tt on tt.corpus = tk.corpus and tt.s <= tk.cpos),
    l as materialized (select *, lead(pos, 1) over w as p1, lead(pos, 2) over w as p2, lag(pos) over w as p_1, lead(word) over w as w1, lead(lemma) over w as l1,
          lag(lemma) over w as l_1, lead(s_id) over w as s1 from t window w as (partition by corpus order by cpos)),
    noun as (select corpus, cpos as match, cpos as matchend from t where pos = 'N'),
    xs as (select corpus, cpos as match, cpos as matchend, s_start, s_end from t where pos = 'X'),
    an as (select corpus, cpos as match, cpos + 1 as matchend, lemma, pos, l1, p1, word, w1, l_1 from l where pos = 'A' and p1 = 'N'),
    raw as (select corpus, cpos as match, case when pos = 'D' and p1 = 'N' then cpos + 1 when pos = 'D' and p1 = 'A' and p2 = 'N' then cpos + 2
            when pos = 'A' and p1 = 'N' then cpos + 1 when pos = 'N' then cpos end as matchend, s_end from l where s_id is not null),
    np0 as (select corpus, match, matchend from raw where matchend <= s_end),
    np as (select corpus, min(match) as match, matchend from np0 group by corpus, matchend),
    dn as (select a.corpus, a.cpos as match, min(b.cpos) as matchend from t a join t b on a.corpus = b.corpus and b.cpos between a.cpos + 1 and a.cpos + 4
           where a.pos = 'D' and b.pos = 'N' group by 1, 2),
    vx as (select corpus, cpos - 1 as match, cpos + 1 as matchend from l where pos = 'V' and p_1 is not null and p1 is not null),
    mix as (select * from dn union select * from vx),
    cl as (select *, sum(new) over (partition by corpus order by match, matchend rows unbounded preceding) as c from (select *, case when match > coalesce(max(matchend) over (partition by corpus
           order by match, matchend rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as new from mix)),
    dns as (select corpus, min(match) as match, matchend from (select a.corpus, a.cpos as match, min(b.cpos) as matchend from t a join t b on a.corpus = b.corpus and b.cpos between a.cpos + 2 and a.cpos + 4
            where a.pos = 'D' and b.pos = 'N' group by 1, 2) group by corpus, matchend),
    dcl as (select *, sum(new) over (partition by corpus order by match, matchend rows unbounded preceding) as c from (select *, case when match > coalesce(max(matchend) over (partition by corpus
           order by match, matchend rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as new from dns)),
    tg as (select n.corpus, n.match, n.matchend, (select arg_min(d.cpos, abs(d.cpos - n.match) * 2 + case when d.cpos < n.match then 0 else 1 end) from t d
           where d.corpus = n.corpus and d.pos = 'D' and d.cpos between n.match - 3 and n.match + 3) as target from noun n),
    names as (select corpus, lead(corpus) over (order by corpus) as other from (select distinct corpus from rg)),
    tx as (select *, struc - min(struc) over (partition by corpus) as k from rg where satt = 'text'),
    beads as (select a.corpus as source, b.corpus as target, a.k as bead, a.s as s1, a.e as s2, b.s as t1, b.e as t2 from tx a
              join names n on n.corpus = a.corpus join tx b on b.corpus = n.other and b.k = a.k)
"""
EV = "with ev as (select user_id::varchar as corpus, row_number() over (partition by user_id order by ts, event_id) - 1 as cpos, event_type as word from events)"
INSIDE = "select corpus, match, matchend from {0} a where {1} exists (select 1 from {0} b where b.corpus = a.corpus and {2} and (b.match <> a.match or b.matchend <> a.matchend))"
GREEDY = """ select corpus, unnest(list_reduce(list([{{'m': match, 'e': matchend}}] order by match, matchend), lambda k, x: case when x[1].m > k[-1].e then list_concat(k, x) else k end)) as r from {0} group by corpus, c"""
XN = "(select b.target as corpus, b.t1 as match, b.t2 as matchend, row_number() over (partition by b.target order by b.t1, b.t2 desc) - 1 as line from xs x join beads b on b.source = x.corpus and x.match between b.s1 and b.s2)"
HOLDS = "b.match <= a.match and b.matchend >= a.matchend"
HELD = "b.match >= a.match and b.matchend <= a.matchend"

SQL: dict[str, str] = {
    "seq_bigram": T + "select corpus, cpos as match, cpos + 1 as matchend from l where pos = 'A' and p1 = 'N' and s_end >= cpos + 1",
    "seq_np_traditional": T + "select * from np0",
    "seq_np_standard": T + "select corpus, match, matchend from np",
    "seq_np_shortest": T + INSIDE.format("np0", "not", HELD),
    "seq_np_longest": T + INSIDE.format("np0", "not", HOLDS),
    "seq_run_longest": T
    + """, ad as (select corpus, cpos, s_id, s_end, cpos - row_number() over (partition by corpus, s_id order by cpos) as isle from t where pos = 'A' and s_id is not null),
        run as (select corpus, s_id, isle, min(cpos) as a, max(cpos) as z, max(s_end) as s_end from ad group by 1, 2, 3)
        select r.corpus, r.a as match, r.z + 1 as matchend from run r join t n on n.corpus = r.corpus and n.cpos = r.z + 1 where n.pos = 'N' and r.z + 1 <= r.s_end""",
    "seq_label": T
    + """select a.corpus, a.cpos as match, min(b.cpos) as matchend from t a join t b on a.corpus = b.corpus and b.cpos between a.cpos + 1 and least(a.cpos + 4, a.s_end)
        where a.pos = 'N' and b.lemma = a.lemma and a.s_id is not null group by 1, 2""",
    "seq_rare": T
    + """, c as (select corpus, s_id, cpos from t where pos = 'C' and s_id is not null), isle as (select *, cpos - row_number() over (partition by corpus, s_id order by cpos) as k from c),
        run as (select corpus, s_id, k, max(cpos) as z from isle group by all)
        select i.corpus, i.cpos as match, z + 1 as matchend from isle i join run using (corpus, s_id, k) join t x on x.corpus = i.corpus and x.cpos = z + 1 and x.s_id = i.s_id where x.pos = 'X'""",
    "seq_label_regex": T
    + """, n as (select corpus, s_id, cpos, word, lemma, lead(cpos) over w as cpos2, lead(word) over w as word2, lead(lemma) over w as lemma2 from t where pos = 'N' and s_id is not null window w as (partition by corpus, s_id order by cpos))
        select corpus, cpos as match, cpos2 as matchend from n where regexp_full_match(lemma2, 'tr.*|.*ist|s.n.*') and word2 <> word""",
    "seq_np_target": T
    + """select corpus, cpos as match, case when p1 = 'N' then cpos + 1 else cpos + 2 end as matchend, case when p1 = 'A' then cpos + 1 else -1 end as target, case when p1 = 'N' then cpos + 1 else cpos + 2 end as keyword
        from l where pos = 'D' and (p1 = 'N' or (p1 = 'A' and p2 = 'N')) and cpos + case when p1 = 'N' then 1 else 2 end <= s_end""",
    "seq_constraint": T + "select corpus, cpos as match, cpos + 2 as matchend from l where pos = 'D' and p2 = 'N' and s_end >= cpos + 2",
    "seq_start_tag": T + "select corpus, cpos as match, cpos + 1 as matchend from l where s_start = cpos and pos = 'D' and p1 is not null and s_end >= cpos + 1",
    "seq_end_tag": T + "select a.corpus, a.cpos as match, b.cpos as matchend from t a join t b on a.corpus = b.corpus and b.cpos = a.cpos + 1 where a.pos <> 'P' and b.s_end = b.cpos",
    "seq_lookahead": T + "select corpus, cpos as match, cpos as matchend from l where pos = 'N' and p1 = 'V'",
    "seq_regex_case": T + "select corpus, cpos as match, cpos as matchend from t where lower(word) like 'tr%' and s_id is not null",
    "seq_regex_diacritics": T + "select corpus, cpos as match, cpos as matchend from t where s_id is not null and regexp_full_match(strip_accents(word), '.*a.*e.*')",
    "seq_frequency": T + "select t.corpus, cpos as match, cpos as matchend from t join (select corpus, lemma, count(*) as n from t group by 1, 2) f on f.corpus = t.corpus and f.lemma = t.lemma where n >= 50 and pos = 'V'",
    "seq_region_value": T + "select corpus, cpos as match, cpos as matchend from t where pos = 'N' and text_value like 'B%'",
    "seq_within_words": T
    + """, d as (select a.corpus, a.cpos as match, min(b.cpos) as matchend from t a join t b on a.corpus = b.corpus and b.cpos between a.cpos + 1 and a.cpos + 4
        where a.pos = 'D' and b.pos = 'N' group by 1, 2) select * from d""",
    "seq_events": EV + ", x as (select *, lead(word) over w as w1, lead(word, 2) over w as w2 from ev window w as (partition by corpus order by cpos)) select corpus, cpos as match, cpos + 2 as matchend from x where word = 'view' and w1 = 'click' and w2 = 'purchase'",
    "seq_events_gap": EV + " select a.corpus, a.cpos as match, min(b.cpos) as matchend from ev a join ev b on a.corpus = b.corpus and b.cpos between a.cpos + 1 and a.cpos + 4 where a.word = 'view' and b.word = 'purchase' group by 1, 2",
    "mu_window": T + "select corpus, cpos as match, cpos as matchend from t a where pos = 'N' and exists (select 1 from t b where b.corpus = a.corpus and b.pos = 'V' and b.cpos between a.cpos - 3 and a.cpos + 2)",
    "mu_region": T + "select corpus, cpos as match, cpos as matchend from t a where pos = 'X' and exists (select 1 from t b where b.corpus = a.corpus and b.pos = 'C' and b.s_id = a.s_id)",
    "mu_nested": T + "select corpus, cpos as match, cpos as matchend from l where (pos = 'X' and (p_1 = 'N' or p1 = 'N')) or (pos = 'C' and p1 = 'V')",
    "tab_gaps": T
    + """, a as (select d.corpus, d.cpos as match, d.s_end, min(n.cpos) as mid from t d join t n on n.corpus = d.corpus and n.cpos > d.cpos where d.pos = 'D' and n.pos = 'N' and n.cpos <= d.cpos + 3 and n.cpos <= d.s_end group by 1, 2, 3),
        b as (select a.corpus, a.match, min(v.cpos) as matchend from a join t v on v.corpus = a.corpus and v.cpos > a.mid and v.cpos <= a.s_end where v.pos = 'V' group by 1, 2)
        select corpus, min(match) as match, matchend from b group by corpus, matchend""",
    "set_union": T + "select corpus, match, matchend from np union select * from noun",
    "set_intersection": T + "select corpus, match, matchend from np intersect select * from noun",
    "set_difference": T + "select corpus, match, matchend from np except select * from noun",
    "prune_minimal": T + INSIDE.format("mix", "not", HELD),
    "prune_maximal": T + INSIDE.format("mix", "not", HOLDS),
    "prune_left_maximal": T + "select corpus, min(match) as match, matchend from (select corpus, match, min(matchend) as matchend from mix group by 1, 2) group by corpus, matchend",
    "prune_non_overlapping": T + "select corpus, r.m as match, r.e as matchend from (" + GREEDY.format("cl") + ")",
    "subquery": T + ", p as (" + GREEDY.format("dcl") + ") select t.corpus, t.cpos as match, t.cpos as matchend from t join p on p.corpus = t.corpus and t.cpos between p.r.m and p.r.e where t.pos = 'V'",
    "regions_merge": T
    + """, f as (select corpus, unnest(list_reduce(list([{'m': match, 'e': matchend}] order by (match * 7919 + matchend * 104729) % 1000003, match, matchend),
            lambda k, x: case when len(list_filter(k, lambda r: r.m <= x[1].m and x[1].m <= r.e and (r.m < x[1].m or r.e > x[1].e))) > 0 then k
                         else list_concat(list_filter(k, lambda r: r.m < x[1].m or r.m > x[1].e), x) end)) as r from cl group by corpus, c)
        select corpus, row_number() over (partition by corpus order by r.m) - 1 as struc, r.m as start, r.e as "end" from f""",
    "delete_duplicates": T + "select corpus, match, matchend from " + XN + " where line not between 2 and 30",
    "keep_containing": T + "select distinct n.corpus, coalesce(t.s_start, n.match) as match, coalesce(t.s_end, n.match) as matchend from noun n join t on t.corpus = n.corpus and t.cpos = n.match where exists (select 1 from xs x where x.corpus = n.corpus and x.match between coalesce(t.s_start, n.match) and coalesce(t.s_end, n.match))",
    "expand_region": T + "select distinct corpus, coalesce(s_start, match) as match, coalesce(s_end, match) as matchend from xs",
    "expand_words": T + "select corpus, greatest(match - 2, 0) as match, matchend from xs",
    "subset_anchor": T + "select np.corpus, np.match, np.matchend from np join t on t.corpus = np.corpus and t.cpos = np.match where t.pos = 'D'",
    "anchor_nearest": T + "select corpus, match, matchend, coalesce(target, -1) as target from tg",
    "anchor_delete": T + "select corpus, match, matchend from tg where target is not null",
    "cut_rows": T + "select corpus, match, matchend from noun qualify row_number() over (partition by corpus order by match) between 6 and 10",
    "delete_rows": T + "select corpus, match, matchend from noun qualify row_number() over (partition by corpus order by match) not between 4 and 41",
    "size_rows": T + "select corpus, count(target) as size from tg group by 1",
    "reduce_percent": T + "select corpus, size, size as distinct_rows, size as of_result from (select corpus, floor(count(*) * 30 / 100)::bigint as size from noun group by 1) where size > 0",
    "scan_bigrams": T + "select corpus, word as word_0, w1 as word_1, count(*) as freq from l where word is not null and w1 is not null group by all",
    "scan_trigrams_pos": T + "select corpus, pos as pos_0, p1 as pos_1, p2 as pos_2, count(*) as freq from l where p2 is not null group by all having count(*) >= 2",
    "scan_filtered": T + "select corpus, lemma as lemma_0, count(*) as freq from l where p1 in ('V', 'N') and s1 is not null group by all having count(*) >= 3",
    "scan_region": T + "select corpus, coalesce(text_value, '') as text_0, pos as pos_0, count(*) as freq from t group by all",
    "lexicon_all": T + "select corpus, word, count(*) as freq, strlen(word)::bigint as len from t where word is not null group by all",
    "lexicon_regex": T + "select corpus, lemma, count(*) as freq, strlen(lemma)::bigint as len from t where regexp_full_match(lemma, 'tr.*|.*ist') group by all",
    "lexicon_sizes": T + "select corpus, count(lemma) as tokens, count(distinct lemma) as types from t group by 1",
    "group_single": T + "select np.corpus, '(all)' as source, t.lemma as target, count(*) as freq from np join t on t.corpus = np.corpus and t.cpos = np.matchend group by all having count(*) >= 2",
    "group_pairs": T + "select tg.corpus, coalesce(t.word, '(none)') as source, 'N' as target, count(*) as freq from tg left join t on t.corpus = tg.corpus and t.cpos = tg.target group by all",
    "group_totals": T + ", g as (select corpus, pos as source, l1 as target, count(*) as freq from an group by all) select corpus, source, (sum(freq) over (partition by corpus, source))::bigint as source_freq, target, freq from g qualify freq >= 2",
    "count_spans": T + """, g as (select corpus, coalesce(lemma, '') || ' ' || coalesce(l1, '') as text, [coalesce(lemma, ''), coalesce(l1, '')] as k, count(*) as size from an group by all)
        select corpus, text, size, (sum(size) over (partition by corpus order by k) - size)::bigint as first from g""",
    "sort_by_word": T + "select t.corpus, match, row_number() over (partition by t.corpus order by coalesce(word, ''), match) - 1 as sort_rank from xs join t on t.corpus = xs.corpus and t.cpos = xs.match",
    "tabulate": T + "select corpus, match, coalesce(word, '') || ' ' || coalesce(w1, '') as item_0, coalesce(l_1, '') as item_1, matchend::varchar as item_2 from an",
    "kwic_words": T
    + """select x.corpus, x.match, coalesce(string_agg(coalesce(t.word, ''), ' ' order by t.cpos) filter (t.cpos < x.match), '') as left_context,
        coalesce(string_agg(coalesce(t.word, ''), ' ' order by t.cpos) filter (t.cpos = x.match), '') as node, coalesce(string_agg(coalesce(t.word, ''), ' ' order by t.cpos) filter (t.cpos > x.match), '') as right_context
        from xs x join t on t.corpus = x.corpus and t.cpos between x.match - 2 and x.match + 2 group by 1, 2""",
    "kwic_attributes": T
    + """, c as (select *, case when cpos = s_start then '<s>' else '' end || coalesce(word, '') || '/' || pos || case when cpos = s_end then '</s>' else '' end as cell from t)
        select x.corpus, 2 * (row_number() over (partition by x.corpus, twice.k order by x.cpos) - 1) + twice.k as line_no, x.cpos as match, case when x.text_id is not null then '<text ' || coalesce(x.text_value, '') || '>' else '' end as structures,
        coalesce(l.cell, '') as left_context, x.cell || '(0)' as node, coalesce(r.cell, '') as right_context
        from (select 0 as k union all select 1) twice, c x left join c l on l.corpus = x.corpus and l.cpos = x.cpos - 1 left join c r on r.corpus = x.corpus and r.cpos = x.cpos + 1 where x.pos = 'X'""",
    "dump_rows": T + "select corpus, row_number() over (partition by corpus order by match) - 1 as line, match, matchend, coalesce(target, -1) as target, -1::bigint as keyword from tg",
    "decode_lines": T + "select corpus, cpos, 0 as ord, coalesce(word, '__UNDEF__') || chr(9) || pos as line from t",
    "describe": T
    + """select corpus, 'p' as kind, 'word' as name, count(*) as tokens, count(distinct word) as types from t group by 1 union all
        select corpus, 'p', 'pos', count(*), count(distinct pos) from t group by 1 union all select corpus, 'p', 'lemma', count(*), count(distinct lemma) from t group by 1 union all
        select corpus, 's', satt, count(*), count(distinct v) from rg group by 1, 3""",
    "align_translate": T + "select b.target as corpus, b.t1 as match, b.t2 as matchend from xs x join beads b on b.source = x.corpus and x.match between b.s1 and b.s2",
    "align_filter": T + "select distinct x.corpus, x.match, x.matchend from xs x join beads b on b.source = x.corpus and x.match between b.s1 and b.s2 where exists (select 1 from t c where c.corpus = b.target and c.pos = 'C' and c.cpos between b.t1 and b.t2)",
    "align_filter_not": T + "select distinct x.corpus, x.match, x.matchend from xs x join beads b on b.source = x.corpus and x.match between b.s1 and b.s2 where not exists (select 1 from t c where c.corpus = b.target and c.pos = 'C' and c.cpos between b.t1 and b.t2)",
    "access_lexicon_ids": T + "select corpus, row_number() over (partition by corpus order by first) - 1 as id, lemma, freq from (select corpus, lemma, min(cpos) as first, count(*) as freq from t group by 1, 2)",
    "access_sort_index": T + "select corpus, row_number() over (partition by corpus order by lemma) - 1 as rank, id from (select corpus, lemma, row_number() over (partition by corpus order by min(cpos)) - 1 as id from t group by 1, 2)",
    "access_structures": T + "select corpus, cpos, s_id as struc, s_start as lbound, s_end as rbound, 1 + 2 * (cpos = s_start)::bigint + 4 * (cpos = s_end)::bigint as flags from t where s_id is not null",
    "boundary_flags": T
    + """select t.corpus, t.cpos, coalesce(1 + 2 * (t.cpos = r.s)::bigint + 4 * (t.cpos = r.e)::bigint, 0) as flags from t
        left join tt r on r.corpus = t.corpus and r.struc = t.text_id""",
    "feature_sets": """with i as (select r.corpus, r.text_id, l.id from region_items r join lexicon l on l.att = 'category' and (r.id = l.id or (r.id is null and lower(trim(r.name)) = l.name))),
        s as (select corpus, text_id, list_sort(list(distinct id::varchar)) as x from i group by 1, 2)
        select corpus, text_id, len(x) as n, case when len(y) > 0 then '|' || array_to_string(y, '|') || '|' else '|' end as common, len(y) as k
        from (select *, list_filter(x, lambda e: e in ('3000', '3001', '3002', '3003', '3004')) as y from s)""",
    "scalar_functions": """with p as (select id, name, name_len, (select coalesce(max(k), 0) from range(1, 9) r(k) where starts_with(name, left('treerish', k))) as k,
        (select coalesce(max(k), 0) from range(1, 5) r(k) where starts_with(name, left('tree', k))) as m from lexicon where att = 'word')
        select id, left(name, k) as prefix, substr(name, m + 1) as minus, starts_with(name, 'tr')::bigint as is_prefix, name_len as number, reverse(name) as reversed from p""",
    "fold_case": "select strip_accents(word) as folded, count(*) as n from tokens where word is not null group by 1",
}
