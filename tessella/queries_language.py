"""Queries that take single features of the language, the results and the access functions, each with SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalar
from tessella.model import Corpus
from tessella.operators import access, alignment, cooccur, display, frequency, intervals, refine, sequence
from tessella.plans.language import parse
from tessella.plans.session import Session, session
from tessella.queries_reference import GREEDY, NOUNS, NP, T, _find, _iv, _kept, _mixed, _targets, _with, text_corpus
from tessella.sources import results, vertical

PARENTS = '[pos="D"] []{1,3} [pos="N"]'


def _ask(text: str, strategy: str = "traditional", variables: dict | None = None, default: str = "word", parents: str | None = None, boundary: int = sequence.BOUNDARY) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = text_corpus(spark, d)
        return _iv(sequence.run(c, parse(text, default), variables, strategy, _find(c, parents) if parents else None, boundary=boundary))

    return run


def feature_corpus(spark: SparkSession, d: str) -> Corpus:
    """Tokens with a feature set of part of speech and first letter; a few without letters have none."""

    def build() -> Corpus:
        c = text_corpus(spark, d)
        feats = F.concat(F.lit("|"), F.col("pos"), F.lit("|"), F.lower(F.substring("lemma", 1, 1)), F.lit("|"))
        tokens = c.tokens.select("corpus", "cpos", "word", F.when(F.col("pos") != "C", feats).alias("feats"))
        return Corpus.build(tokens, None, ("word", "feats"))

    return _kept(spark, d, "features", build)


def _features(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _iv(sequence.run(feature_corpus(spark, d), parse(text), strategy="traditional"))


def _session(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """What a command session makes of ``text`` over all corpora at once."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        s: Session = session({"ALL": text_corpus(spark, d)})
        return s.run(text)

    return run


def _round_trip(c: Corpus) -> DataFrame:
    """Decoded to lines with tags, and read as vertical text again."""
    lines = display.decode(c, ["word", "pos"], satts=["s"]).select("corpus", F.lit("f").alias("file"), (F.col("cpos") * 4 + F.col("ord") + 1).alias("line_no"), F.col("line").alias("raw"))
    tokens, regions = vertical.encode(lines, ("word", "pos"), [vertical.Structure.parse("s")])
    at = regions.select("corpus", F.col("start").alias("cpos"), "struc", "end")
    return tokens.join(at, ["corpus", "cpos"], "left").select("corpus", "cpos", "word", "pos", F.coalesce("struc", F.lit(-1).cast("long")).alias("struc"), F.coalesce("end", F.lit(-1).cast("long")).alias("end"))


def _undumped(c: Corpus) -> DataFrame:
    rows = display.dump(_targets(c)).select("corpus", "line", "match", "matchend", "target")
    return results.undump(c, rows).select("corpus", "match", "matchend", F.coalesce("target", F.lit(-1).cast("long")).alias("target"), "sort_rank")


def _sampled(c: Corpus) -> DataFrame:
    nouns = _find(c, NOUNS)
    rows = refine.reduce(nouns, 50, seed=3)
    return refine.size(intervals.intersection(rows, nouns))


def _classes(c: Corpus) -> DataFrame:
    mapping = c.tokens.sparkSession.createDataFrame([("open", "N"), ("open", "V"), ("closed", "D"), ("closed", "P"), ("any", "V")], "class string, token string")
    return display.class_columns(c.tokens, mapping, "pos").groupBy("corpus", "class").agg(F.count("*").alias("n")).select("corpus", F.coalesce("class", F.lit("-")).alias("class"), "n")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/lexicon.parquet").filter("att = 'word'").select(F.col("name").alias("item"))
    return frequency.lexicon_export(text_corpus(spark, d), "lemma", lookup=names, keep_unknown=True).select("corpus", "lemma", "freq")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("raw_line")
    return spark.read.parquet(f"{d}/raw_lines.parquet").select("line_id", scalar.zap_controls(r).alias("zapped"), scalar.entity_decode(r).alias("decoded"), F.char_length(r).cast("long").alias("characters"), F.reverse(r).alias("reversed"), scalar.valid_text(r).cast("long").alias("valid"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lang_default_attribute": _ask('"N" "V|A"', default="pos"),
    "lang_variable": _ask("[pos = $v] [pos != $v & pos = RE($r)]", variables={"v": {"N", "V"}, "r": {"[A-C]", "X"}}),
    "lang_literal": _ask('[pos = "N"%l & lemma != ".*"%l & lemma = "T.*"%c]'),
    "lang_contains": _features('[feats contains "N" & feats not contains "t|s"]'),
    "lang_matches": _features('[feats matches "[A-Z]|[a-m]"] | [feats contains "X.*"]'),
    "lang_ambiguity": _features('[ambiguity(feats) = 0 | unify(feats, "|N|t|") = "|N|t|"%l]'),
    "lang_unify_labels": _features('a:[feats contains "N"] []{0,2} [feats contains "V" & unify(a.feats, feats) != "|"%l]'),
    "lang_same_attributes": _ask('[word = lemma & pos != "N"] [word != lemma]'),
    "lang_existence": _ask("[s & text & !rbound(s)] [rbound(s)]"),
    "lang_implication": _ask('[pos = "N" -> lemma = "t.*"] [!(pos = "D" | pos = "A")] [pos = "X"]'),
    "lang_arithmetic": _ask('a:[pos="D"] []{0,3} b:[pos="N"] :: add(dist(a, b), mul(distabs(b, a), 2)) = 6 & sub(b, a) = distance(a, b)'),
    "lang_bounds_of": _ask('a:[pos="D"] []{0,2} b:[pos="N"] :: lbound_of(s, a) = a & rbound_of(s, b) > b & lbound(s, a) within s'),
    "lang_prefix": _ask('[is_prefix("t", lemma) & minus(lemma, "tr") != lemma & prefix(lemma, "tra") = "tr"]'),
    "lang_int": _ask('[int(lemma) = 0 & int("12x") = 12 & pos = "C"]'),
    "lang_normalize": _ask('[normalize(word, "d") != word]'),
    "lang_delete_label": _ask('a:[pos="D"] b:[pos=/undef[a] | pos = "N"] :: b'.replace("pos=/undef[a] | ", "ignore(~a) & ")),
    "lang_anchor_start": _ask('<match> [] [pos="A"]', parents=PARENTS),
    "lang_anchor_end": _ask('[pos!="D"] [pos="N"] </match>', parents=PARENTS),
    "lang_within_regions": _ask('[pos="C"] []* [pos="X"] within 2 s'),
    "lang_cut": _ask('[pos="N"] cut 7'),
    "lang_expand": _ask('[pos="X"] expand left to 1 s'),
    "lang_embedded_strategy": _ask('(?longest) [pos="A"]+ [pos="N"]', "standard"),
    "lang_tag_value": _ask('<text = "B.*"> [] []'),
    "lang_boundary": _ask('[pos="D"] []* [pos="N"]', boundary=3),
    "lang_macro_region": lambda spark, d: _iv(_session("(?longest) /region[s]")(spark, d)),
    "lang_codist": _session('/codist[lemma, "tr.*", pos]'),
    "session_commands": lambda spark, d: _iv(_session('A = [pos="A"] [pos="N"]; B = [pos="N"]; set B target nearest [pos="D"] within 3 words from match; C = subset B where target: [pos="D"]; D = union A C; D = diff D A')(spark, d)),
    "session_group": _session('A = [pos="A"] [pos="N"]; group A matchend lemma by match pos cut 2'),
    "session_count": lambda spark, d: _session('A = [pos="X"]; count A by lemma desc cut 2')(spark, d).select("corpus", "text", "size", "first"),
    "anchor_move": _with(lambda c: _iv(refine.set_anchor(_targets(c), "match", "target"))),
    "anchor_erase": _with(lambda c: refine.size(refine.set_anchor(_targets(c), "target", None), "target")),
    "mu_cut": _with(lambda c: _iv(cooccur.run_mu(c, parse('MU(meet [pos="X"] [pos="C"] -2 2) cut 5')))),
    "tab_fixed": _with(lambda c: _iv(cooccur.run_tab(c, parse('TAB [pos="D"] {2} [pos="V"]')))),
    "matches_complement": _with(lambda c: _iv(intervals.complement(c.tokens, _find(c, NOUNS)))),
    "prune_unique": _with(lambda c: _iv(intervals.unique(_mixed(c).unionByName(_mixed(c))))),
    "sort_descending": _with(lambda c: frequency.sort(c, _find(c, '[pos="X"]'), "lemma", descending=True).select("corpus", "match", "sort_rank")),
    "sort_reversed": _with(lambda c: frequency.sort(c, _find(c, '[pos="X"]'), "pos", span=frequency.Span("match", -1, "match", -1), reverse=True).select("corpus", "match", "sort_rank")),
    "group_offset": _with(lambda c: frequency.group(c, _find(c, NP), "match", "pos", offset=-1)),
    "group_region": _with(lambda c: frequency.group(c, _find(c, NP), "match", "text", cut=3)),
    "tabulate_spans": _with(lambda c: display.tabulate(c, _find(c, '[pos="A"] [pos="N"]'), [display.Item(frequency.Span("match", -1, "matchend", 1), "pos"), display.Item(frequency.Span("matchend", 0, "match", -1), "lemma"), display.single("match", "text")]).select("corpus", "match", "item_0", "item_1", "item_2")),
    "kwic_characters": _with(lambda c: display.kwic(c, _find(c, '[pos="X"]'), 10, 6).select("corpus", "match", "left_context", "node", "right_context")),
    "kwic_regions": _with(lambda c: display.kwic(c, _find(c, '[pos="X"]'), 1, 1, "s", "pos").select("corpus", "match", "left_context", "node", "right_context")),
    "undump_rows": _with(_undumped),
    "reduce_count": _with(_sampled),
    "decode_xml": _with(lambda c: display.decode(c, ["word", "pos"], satts=["s"], mode="xml")),
    "decode_lisp": _with(lambda c: display.decode(c, ["pos"], mode="lisp")),
    "decode_horizontal": _with(lambda c: display.decode_horizontal(c, ["word", "pos"], "s")),
    "encode_round_trip": _with(_round_trip),
    "export_regions": _with(lambda c: vertical.export_regions(c.regions, "text").select("corpus", "line")),
    "align_views": _with(lambda c: alignment.bead_text(c, c, "pos")),
    "access_lookup": _with(lambda c: access.regex2id(c, "lemma", "tr.*").join(c.lexicon("lemma"), ["corpus", "id"]).select("corpus", "id", "lemma", "freq")),
    "access_ids": _with(lambda c: access.cpos2id(c, "lemma")),
    "access_postings": _with(lambda c: access.id2cpos(c, "lemma", [0, 1, 7])),
    "access_regions": _with(lambda c: access.struc2cpos(c, "s", [0, 3, 50])),
    "access_beads": _with(access.cpos2alg),
    "access_sizes": _with(lambda c: access.max_id(c, "lemma").join(access.max_cpos(c, "lemma"), "corpus").join(access.max_struc(c, "s"), "corpus")),
    "lexicon_list": _listed,
    "scan_slice": _with(lambda c: frequency.scan(c, ["pos+0", "pos+2"], start=100, end=5000)),
    "scan_negated": _with(lambda c: frequency.scan(c, ["pos+0", "?pos+1!=/N|V/", "?s+0"])),
    "class_columns": _with(_classes),
    "scalar_texts": _texts,
}

FE = T + ", f as (select corpus, cpos, word, pos, lower(left(lemma, 1)) as c, lead(pos) over w as p1, lead(pos, 2) over w as p2 from t window w as (partition by corpus order by cpos))"
LEX = T + ", lex as (select corpus, lemma, row_number() over (partition by corpus order by min(cpos)) - 1 as id, count(*) as freq from t group by 1, 2)"
ONE = "select corpus, cpos as match, cpos as matchend from "

SQL: dict[str, str] = {
    "lang_default_attribute": T + "select corpus, cpos as match, cpos + 1 as matchend from l where pos = 'N' and p1 in ('V', 'A')",
    "lang_variable": T + "select corpus, cpos as match, cpos + 1 as matchend from l where pos in ('N', 'V') and p1 in ('A', 'B', 'C', 'X')",
    "lang_literal": T + ONE + "t where pos = 'N' and lower(lemma) like 't%'",
    "lang_contains": FE + ONE + "f where pos = 'N' and c not in ('t', 's')",
    "lang_matches": FE + ONE + "f where pos <> 'C' and ((length(pos) = 1 and c between 'a' and 'm') or pos like 'X%')",
    "lang_ambiguity": FE + ONE + "f where pos = 'C' or (pos = 'N' and c = 't')",
    "lang_unify_labels": FE
    + """ select a.corpus, a.cpos as match, min(b.cpos) as matchend from f a join f b on b.corpus = a.corpus and b.cpos between a.cpos + 1 and a.cpos + 3
        where a.pos = 'N' and b.pos = 'V' and a.c = b.c group by 1, 2""",
    "lang_same_attributes": T + "select corpus, cpos as match, cpos + 1 as matchend from l where word = lemma and pos <> 'N' and w1 <> l1",
    "lang_existence": T + "select a.corpus, a.cpos as match, b.cpos as matchend from t a join t b on b.corpus = a.corpus and b.cpos = a.cpos + 1 where a.s_id is not null and a.text_id is not null and a.cpos <> a.s_end and b.cpos = b.s_end",
    "lang_implication": T + "select corpus, cpos as match, cpos + 2 as matchend from l where (pos <> 'N' or lemma like 't%') and p1 not in ('D', 'A') and p2 = 'X'",
    "lang_arithmetic": T + "select corpus, cpos as match, cpos + 2 as matchend from l where pos = 'D' and p2 = 'N'",
    "lang_bounds_of": T
    + """select a.corpus, a.cpos as match, min(b.cpos) as matchend from t a join t b on b.corpus = a.corpus and b.cpos between a.cpos + 1 and a.cpos + 3
        where a.pos = 'D' and b.pos = 'N' and a.s_start = a.cpos and b.s_end = a.s_end and b.s_end > b.cpos group by 1, 2""",
    "lang_prefix": T + ONE + "t where lemma like 'tr%' and lemma not like 'tra%'",
    "lang_int": T + ONE + "t where pos = 'C' and coalesce(try_cast(regexp_extract(lemma, '^[0-9]+') as bigint), 0) = 0",
    "lang_normalize": T + ONE + "t where strip_accents(word) <> word",
    "lang_delete_label": T + "select corpus, cpos as match, cpos + 1 as matchend from l where pos = 'D' and p1 = 'N'",
    "lang_anchor_start": T + ", p as (" + GREEDY.format("dcl") + ") select p.corpus, r.m as match, r.m + 1 as matchend from p join t on t.corpus = p.corpus and t.cpos = r.m + 1 where t.pos = 'A'",
    "lang_anchor_end": T + ", p as (" + GREEDY.format("dcl") + ") select p.corpus, r.e - 1 as match, r.e as matchend from p join t on t.corpus = p.corpus and t.cpos = r.e - 1 where t.pos <> 'D'",
    "lang_within_regions": T
    + """, last as (select corpus, max(struc) as z from sx group by 1), x as (select corpus, cpos from t where pos = 'X'),
        c as (select t.corpus, t.cpos, r.e from t join last using (corpus) join sx r on r.corpus = t.corpus and r.struc = least(t.s_id + 1, z) where pos = 'C' and t.s_id is not null)
        select c.corpus, c.cpos as match, x.cpos as matchend from c asof join x on x.corpus = c.corpus and x.cpos > c.cpos where x.cpos <= c.e""",
    "lang_cut": T + "select corpus, match, matchend from noun qualify row_number() over (partition by corpus order by match) <= 7",
    "lang_expand": T + "select distinct corpus, coalesce(s_start, match) as match, matchend from xs",
    "lang_embedded_strategy": T
    + """, ad as (select corpus, cpos, cpos - row_number() over (partition by corpus order by cpos) as isle from t where pos = 'A'), run as (select corpus, isle, min(cpos) as a, max(cpos) as z from ad group by 1, 2)
        select r.corpus, r.a as match, r.z + 1 as matchend from run r join t n on n.corpus = r.corpus and n.cpos = r.z + 1 where n.pos = 'N'""",
    "lang_tag_value": T + "select t.corpus, t.cpos as match, t.cpos + 1 as matchend from t join tt on tt.corpus = t.corpus and tt.struc = t.text_id and tt.s = t.cpos join t n on n.corpus = t.corpus and n.cpos = t.cpos + 1 where t.text_value like 'B%' and t.cpos < tt.e",
    "lang_boundary": T + "select corpus, match, min(matchend) as matchend from (select a.corpus, a.cpos as match, b.cpos as matchend from t a join t b on b.corpus = a.corpus and b.cpos between a.cpos + 1 and a.cpos + 3 where a.pos = 'D' and b.pos = 'N') group by 1, 2",
    "lang_macro_region": T + "select distinct corpus, s_start as match, s_end as matchend from t where s_id is not null",
    "lang_codist": T + ", g as (select corpus, lemma as source, pos as target, count(*) as freq from t where lemma like 'tr%' group by all) select corpus, source, (sum(freq) over (partition by corpus, source))::bigint as source_freq, target, freq from g",
    "session_commands": T + "select corpus, match, matchend from tg where target is not null",
    "session_group": T + "select corpus, pos as source, l1 as target, count(*) as freq from an group by all having count(*) >= 2",
    "session_count": T
    + """, g as (select t.corpus, t.lemma as text, count(*) as size from xs join t on t.corpus = xs.corpus and t.cpos = xs.match group by all),
        r as (select corpus, text, size, (sum(size) over (partition by corpus order by text desc) - size)::bigint as first from g) select * from r where size >= 2""",
    "anchor_move": T + "select corpus, least(coalesce(target, match), matchend) as match, matchend from tg",
    "anchor_erase": T + "select corpus, 0::bigint as size from tg group by 1",
    "mu_cut": T
    + """select corpus, cpos as match, cpos as matchend from t a where pos = 'X' and exists (select 1 from t b where b.corpus = a.corpus and b.pos = 'C' and b.cpos between a.cpos - 2 and a.cpos + 2)
        qualify row_number() over (partition by corpus order by cpos) <= 5""",
    "tab_fixed": T + "select a.corpus, a.cpos as match, a.cpos + 3 as matchend from t a join t b on b.corpus = a.corpus and b.cpos = a.cpos + 3 where a.pos = 'D' and b.pos = 'V'",
    "matches_complement": T + ONE + "t where pos <> 'N'",
    "prune_unique": T + "select * from mix",
    "sort_descending": T + "select t.corpus, match, row_number() over (partition by t.corpus order by lemma desc, match desc) - 1 as sort_rank from xs join t on t.corpus = xs.corpus and t.cpos = xs.match",
    "sort_reversed": T + "select x.corpus, match, row_number() over (partition by x.corpus order by reverse(coalesce(pos, '')), t.cpos is not null, match) - 1 as sort_rank from xs x left join t on t.corpus = x.corpus and t.cpos = x.match - 1",
    "group_offset": T + "select np.corpus, '(all)' as source, coalesce(t.pos, '(none)') as target, count(*) as freq from np left join t on t.corpus = np.corpus and t.cpos = np.match - 1 group by all",
    "group_region": T + "select np.corpus, '(all)' as source, coalesce(t.text_value, '(none)') as target, count(*) as freq from np join t on t.corpus = np.corpus and t.cpos = np.match group by all having count(*) >= 3",
    "tabulate_spans": T
    + """select a.corpus, a.match, (select string_agg(pos, ' ' order by cpos) from t where t.corpus = a.corpus and t.cpos between a.match - 1 and a.matchend + 1) as item_0,
        a.l1 || ' ' || a.lemma || case when a.match > 0 then ' ' || a.l_1 else '' end as item_1, coalesce(t.text_value, '') as item_2 from an a join t on t.corpus = a.corpus and t.cpos = a.match""",
    "kwic_characters": T
    + """select x.corpus, x.match, right(coalesce(string_agg(coalesce(t.word, ''), ' ' order by t.cpos) filter (t.cpos < x.match), ''), 10) as left_context,
        coalesce(string_agg(coalesce(t.word, ''), ' ' order by t.cpos) filter (t.cpos = x.match), '') as node, left(coalesce(string_agg(coalesce(t.word, ''), ' ' order by t.cpos) filter (t.cpos > x.match), ''), 6) as right_context
        from xs x join t on t.corpus = x.corpus and t.cpos between x.match - 11 and x.match + 7 group by 1, 2""",
    "kwic_regions": T
    + """select x.corpus, x.match, coalesce(string_agg(t.pos, ' ' order by t.cpos) filter (t.cpos < x.match), '') as left_context, 'X' as node, coalesce(string_agg(t.pos, ' ' order by t.cpos) filter (t.cpos > x.match), '') as right_context
        from xs x join t on t.corpus = x.corpus and t.cpos between coalesce(x.s_start, x.match) and coalesce(x.s_end, x.match) group by 1, 2""",
    "undump_rows": T + "select corpus, match, matchend, coalesce(target, -1) as target, row_number() over (partition by corpus order by match) - 1 as sort_rank from tg",
    "reduce_count": T + "select corpus, least(count(*), 50) as size from noun group by 1",
    "decode_xml": T
    + """, e as (select *, replace(replace(replace(coalesce(word, '__UNDEF__'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as w from t)
        select corpus, cpos, 0 as ord, '<token><attr name="word">' || w || '</attr><attr name="pos">' || pos || '</attr></token>' as line from e
        union all select corpus, cpos, -1, '<s>' from t where s_start = cpos union all select corpus, cpos, 1, '</s>' from t where s_end = cpos""",
    "decode_lisp": T + "select corpus, cpos, 0 as ord, '(\"' || pos || '\")' as line from t",
    "decode_horizontal": T + "select corpus, s_id as struc, string_agg(coalesce(word, '__UNDEF__') || '/' || pos, ' ' order by cpos) as line from t where s_id is not null group by 1, 2",
    "encode_round_trip": T
    + """, n as (select corpus, cpos, row_number() over (partition by corpus order by cpos) - 1 as k, coalesce(nullif(word, ''), '__UNDEF__') as word, pos, s_start, s_end from t),
        r as (select a.corpus, a.k, z.k as e, row_number() over (partition by a.corpus order by a.k) - 1 as struc from n a join n z on z.corpus = a.corpus and z.cpos = a.s_end where a.cpos = a.s_start)
        select n.corpus, n.k as cpos, word, pos, coalesce(struc, -1) as struc, coalesce(e, -1) as "end" from n left join r on r.corpus = n.corpus and r.k = n.k""",
    "export_regions": T + "select corpus, s || chr(9) || e || coalesce(chr(9) || v, '') as line from tt",
    "align_views": T
    + """, a as (select b.source, b.target, b.bead, string_agg(t.pos, ' ' order by t.cpos) as source_text from beads b join t on t.corpus = b.source and t.cpos between b.s1 and b.s2 group by 1, 2, 3),
        z as (select b.source, b.target, b.bead, string_agg(t.pos, ' ' order by t.cpos) as target_text from beads b join t on t.corpus = b.target and t.cpos between b.t1 and b.t2 group by 1, 2, 3)
        select * from a full join z using (source, target, bead)""",
    "access_lookup": LEX + " select corpus, id, lemma, freq from lex where lemma like 'tr%'",
    "access_ids": LEX + " select t.corpus, cpos, id from t join lex using (corpus, lemma)",
    "access_postings": LEX + " select t.corpus, id, cpos from t join lex using (corpus, lemma) where id in (0, 1, 7)",
    "access_regions": T + "select corpus, struc, s as start, e as \"end\", v as value from sx join (select corpus, struc, v from rg where satt = 's') using (corpus, struc) where struc in (0, 3, 50)",
    "access_beads": T + "select t.corpus, t.cpos, b.target, b.bead from t join beads b on b.source = t.corpus and t.cpos between b.s1 and b.s2",
    "access_sizes": T + "select corpus, count(distinct lemma) as max_id, max(cpos) + 1 as max_cpos, (select count(*) from sx where sx.corpus = t.corpus) as max_struc from t group by 1",
    "lexicon_list": T + "select c.corpus, name as lemma, coalesce(n, 0) as freq from lexicon cross join (select distinct corpus from t) c left join (select corpus, lemma, count(*) as n from t group by 1, 2) f on f.corpus = c.corpus and f.lemma = name where att = 'word'",
    "scan_slice": T + "select corpus, pos as pos_0, p2 as pos_2, count(*) as freq from l where cpos >= 100 and cpos + 2 < 5000 and p2 is not null group by all",
    "scan_negated": T + "select corpus, pos as pos_0, count(*) as freq from l where p1 not in ('N', 'V') and s_id is not null group by all",
    "class_columns": T + "select corpus, case pos when 'N' then 'open' when 'V' then 'any' when 'D' then 'closed' when 'P' then 'closed' else '-' end as class, count(*) as n from t group by all",
    "scalar_texts": r"""select line_id, regexp_replace(raw_line, '[\x00-\x1f]', '?', 'g') as zapped, replace(replace(replace(replace(replace(raw_line, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') as decoded,
        length(raw_line) as characters, reverse(raw_line) as reversed, case when raw_line is not null then 1 end as valid from raw_lines""",
}
