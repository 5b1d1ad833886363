"""Queries of the training-data problems, over the driver's tables."""

from __future__ import annotations

import html.entities

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.encodings import find_garbled, garbled_documents, restore
from tessella.llm.leaks import BREAKING, find_leaks, remove_leaks
from tessella.llm.mixing import mix, shares
from tessella.llm.pairs import associations, basket_items
from tessella.llm.terms import distinctiveness, term_frequencies, top_terms
from tessella.session import cut


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lexicon = _t(spark, d, "lexicon")
    scored = distinctiveness(_t(spark, d, "text_terms"), lexicon, min_df=1, scores=("tfidf",))
    return top_terms(scored, lexicon, "tfidf").select("corpus", "text_id", "name")


def p2_divergence(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctiveness(_t(spark, d, "text_terms"), _t(spark, d, "lexicon"), scores=("divergence",))
    return scored.select("corpus", "text_id", "id", "freq", (F.round("divergence", 6) + F.lit(0.0)).alias("divergence"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_lift(spark, d).select("corpus", "id_a", "id_b")


def p3_lift(spark: SparkSession, d: str) -> DataFrame:
    found = associations(basket_items(_t(spark, d, "region_items"), _t(spark, d, "lexicon")))
    return found.select("corpus", "id_a", "id_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_t(spark, d, "text_terms"), _t(spark, d, "lexicon")).filter("mark is not null").select("corpus", "id", "mark")


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_t(spark, d, "text_terms"), _t(spark, d, "lexicon"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_spans(spark, d).select("doc_id", "item_id")


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(_t(spark, d, "documents"), _t(spark, d, "test_items"))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    done = remove_leaks(_t(spark, d, "documents"), _t(spark, d, "test_items"))
    return done.select("doc_id", F.length("text").cast("long").alias("n_chars"), "removed_words", "doc_words", "dropped")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p7_mix(spark, d), _t(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_documents(_t(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    documents = _t(spark, d, "documents")
    return restore(documents, cut(find_garbled(documents), "garbled"))


QUERIES = {
    "p2_found": p2_found,
    "p2_divergence": p2_divergence,
    "p3_found": p3_found,
    "p3_lift": p3_lift,
    "p4_found": p4_found,
    "p4_frequencies": p4_frequencies,
    "p6_found": p6_found,
    "p6_spans": p6_spans,
    "p6_cleaned": p6_cleaned,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

ENTRIES = """
    with held as (select * from text_terms qualify row_number() over (partition by entry_id order by loaded_at desc) = 1),
    e as (select h.corpus, h.text_id, l.id, l.name, sum(h.freq)::bigint as freq
          from held h join lexicon l on l.att = 'word' and (h.id = l.id or (h.id is null and lower(trim(h.name)) = l.name))
          where h.freq >= 1 group by 1, 2, 3, 4),
    n as (select corpus, count(distinct text_id) as n, sum(freq) as total from e group by 1),
    s as (select corpus, id, count(*) as df, sum(freq)::bigint as cf from e group by 1, 2),
    len as (select corpus, text_id, sum(freq) as length from e group by 1, 2)"""

ITEMS = """
    with i as (select distinct r.corpus, r.text_id, l.id from region_items r
               join lexicon l on l.att = 'category' and (r.id = l.id or (r.id is null and lower(trim(r.name)) = l.name))),
    n as (select corpus, count(distinct text_id) as n from i group by 1),
    c as (select corpus, id, count(*) as n_i from i group by 1, 2),
    ab as (select x.corpus, x.id as id_a, y.id as id_b, count(*) as n_ab from i x join i y
           on x.corpus = y.corpus and x.text_id = y.text_id and x.id < y.id group by 1, 2, 3 having count(*) >= 5),
    found as (select ab.corpus, id_a, id_b, n_ab, a.n_i as n_a, b.n_i as n_b, n.n, round(n_ab * n.n / (a.n_i * b.n_i)::double, 6) as lift
              from ab join n using (corpus) join c a on a.corpus = ab.corpus and a.id = id_a
              join c b on b.corpus = ab.corpus and b.id = id_b where n_ab * n.n >= 4 * a.n_i * b.n_i)"""

def _words_sql() -> str:
    """CTEs that read documents and items into words as ``llm.leaks.words`` does, and pair their runs of eight words.

    Named character references are those of the standard library; numeric ones are resolved by number.
    """
    names = {n: c for n, c in html.entities.html5.items() if n.endswith(";") and n[:-1].isalnum()}
    listed = ", ".join("'&{}': '{}'".format(n, c.replace("'", "''")) for n, c in sorted(names.items()))
    letter, mark = r"[\p{L}\p{N}]", r"[\x{300}-\x{36f}]"
    text = r"""
    with src as (select 'd' as kind, doc_id as id, text from documents where doc_id is not null and text is not null
                 union all select 'i', item_id, text from test_items where item_id is not null and text is not null),
    ent as (select map {LISTED} as m),
    a as (select kind, id, row_number() over () as row, regexp_replace(regexp_replace(regexp_replace(text, '<!--.*?-->', '', 'gs'), '</?(?:BREAKING)(?:\s[^<>]*)?/?>', ' ', 'gi'), '</?[A-Za-z][^<>]*>', '', 'g') as x from src),
    p as (select kind, id, row, unnest(regexp_extract_all(x, '&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|[^&]+|&', 0, 's')) as e, generate_subscripts(regexp_extract_all(x, '&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|[^&]+|&', 0, 's'), 1) as nr from a),
    b as (select kind, id, row, string_agg(case when regexp_full_match(e, '&#[0-9]+;') then chr(try_cast(e[3:len(e) - 1] as int)) when regexp_full_match(e, '&#[xX][0-9a-fA-F]+;') then chr(try_cast('0x' || e[4:len(e) - 1] as int))
                 when e[1] = '&' and len(e) > 1 then coalesce(m[e], e) else e end, '' order by nr) as x from p, ent group by all),
    c as (select kind, id, row, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?m)^[ \t:]*(?:\{\||\|-)[^\n]*', ' ', 'g'), '\[(?:https?|ftp)?:?//[^\s\]]*', ' ', 'g'),
          '\[\[[^\[\]\n|]*(?:\|[^\[\]\n|]*)*\|', '', 'g'), '''{2,}|\[\[|\]\]|[\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g') as x from b),
    w as (select kind, id, row, list_transform(regexp_extract_all(x, 'LETTER(?:MARK*LETTER|MARK)*'), lambda v: replace(replace(nfc_normalize(lower(v)), 'ß', 'ss'), 'ς', 'σ')) as v from c),
    g as (select kind, id, row, len(v) as n, k, array_to_string(v[k:k + 7], ' ') as gram from (select *, unnest(range(1, len(v) - 6)) as k from w where len(v) >= 8)),
    hit as (select distinct d.id as doc_id, d.row, d.n as doc_words, i.id as item_id, d.k from g d join (select distinct id, gram from g where kind = 'i') i using (gram) where d.kind = 'd')"""
    return text.replace("LISTED", listed).replace("BREAKING", BREAKING).replace("LETTER", letter).replace("MARK", mark)


LEAKED = _words_sql()

SQL = {
    "p6_found": LEAKED + " select doc_id, item_id from (select distinct row, doc_id, item_id from hit)",
    "p6_spans": LEAKED
    + """, isle as (select *, k - row_number() over (partition by row, item_id order by k) as run from hit),
        span as (select row, item_id, run, count(*) + 7 as size from isle group by 1, 2, 3), most as (select row, item_id, max(size) as longest from span group by 1, 2),
        word as (select row, doc_id, item_id, doc_words, count(distinct wd) as matched from (select *, unnest(range(k, k + 8)) as wd from hit) group by 1, 2, 3, 4),
        size as (select id as item_id, max(len(v)) as item_words from w where kind = 'i' group by 1)
        select doc_id, item_id, longest::int as longest, matched::int as matched, item_words::int as item_words, doc_words::int as doc_words from word join most using (row, item_id) join size using (item_id)""",
    "p2_found": ENTRIES
    + """, r as (select e.corpus, e.text_id, e.name, round(e.freq * ln(n.n / s.df), 6) as score
              from e join s using (corpus, id) join n using (corpus))
        select corpus, text_id, name from r where score > 0
        qualify row_number() over (partition by corpus, text_id order by score desc, name) <= 3""",
    "p2_divergence": ENTRIES
    + """, r as (select e.corpus, e.text_id, e.id, e.freq, s.cf / n.total::double as q, length, df
              from e join s using (corpus, id) join n using (corpus) join len on len.corpus = e.corpus and len.text_id = e.text_id)
        select corpus, text_id, id, freq, round((freq + 2000 * q) / (length + 2000) * ln((freq + 2000 * q) / (length + 2000) / q), 6) + 0.0 as divergence
        from r where df >= 2""",
    "p3_found": ITEMS + " select corpus, id_a, id_b from found",
    "p3_lift": ITEMS + " select * from found",
    "p4_found": ENTRIES
    + """ select corpus, id, case when df * 10 > n then 'common' else 'rare' end as mark
        from s join n using (corpus) where df * 10 > n or df < 3 or cf < 5""",
    "p4_frequencies": ENTRIES
    + """ select corpus, id, cf, df, n, case when df * 10 > n then 'common' when df < 3 or cf < 5 then 'rare' end as mark
        from s join n using (corpus)""",
}
