"""Queries of the general problems, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.skew import key_runs
from tessella.operators.streams import stream_report
from tessella.sources.lines import read_lines, reclassify, valid_lines


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return stream_report(_t(spark, d, "tokens"), _t(spark, d, "id_streams")).filter("wrong").select("corpus", "id")


def p1_key_runs(spark: SparkSession, d: str) -> DataFrame:
    tokens = _t(spark, d, "tokens").filter("corpus is not null and id is not null")
    return key_runs(tokens, ["corpus", "id"], "cpos")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return reclassify(read_lines(_t(spark, d, "raw_lines"), _t(spark, d, "encode_runs"))).select("line_id", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    read = valid_lines(read_lines(_t(spark, d, "raw_lines"), _t(spark, d, "encode_runs")))
    return read.filter("kind = 'token'").select("line_id", "run_id", "record.word", "record.pos", "record.lemma", "record.feats", F.col("record.freq").cast("string").alias("freq"))


QUERIES = {"p1_found": p1_found, "p1_key_runs": p1_key_runs, "p5_found": p5_found, "p5_loaded": p5_loaded}

# Every line with its run's settings as regular expressions: S the class of separators, Q the quote, F a field.
LINES = r"""
    with r as (select run_id, undef_value as u, quote_char as q, '[' || regexp_replace(field_separators, '([^\w\s])', '\\\1', 'g') || ']' as sep,
               regexp_replace(field_separators, '([^\w\s])', '\\\1', 'g') as seps, regexp_escape(quote_char) as qe, string_split_regex(trim(column_names), ' +') as names,
               left(field_separators, 1) as one from encode_runs),
    f as (select *, case when q is null then '[^' || seps || ']*' else qe || '(?:[^' || qe || ']|' || qe || qe || ')*' || qe || '|[^' || seps || qe || ']*' end as field from r),
    l as (select line_id, run_id, raw_line as raw, regexp_matches(raw_line, '^<(?:/?[A-Za-z]|[!?])') as tag, f.* exclude (run_id) from raw_lines join f using (run_id)),
    x as (select *, regexp_matches(raw, '^<[!?]') or regexp_full_match(raw, '</[A-Za-z][\p{L}\p{M}\p{Nd}_.\-]*[ \t]*>', 's')
                 or regexp_full_match(raw, '<[A-Za-z][\p{L}\p{M}\p{Nd}_.\-]*(?:[ \t]+[\p{L}\p{M}\p{Nd}_.\-]+=(?:"[^"]*"|''[^'']*''|[^ \t"''>]+))*[ \t]*/?[ \t]*>', 's') as tag_ok,
                 regexp_full_match(raw, '(?:' || field || ')(?:' || sep || '(?:' || field || '))*', 's') as sound,
                 list_transform(regexp_extract_all(one || raw, sep || '(' || field || ')', 1, 's'), lambda v: case when q is not null and v[1] = q then replace(v[2:len(v) - 1], q || q, q) else v end) as fields from l),
    y as (select *, case when list_contains(names, 'word') then fields[list_position(names, 'word')] end as word, nullif(nullif(fields[list_position(names, 'pos')], ''), u) as pos,
                 nullif(nullif(fields[list_position(names, 'lemma')], ''), u) as lemma, nullif(nullif(fields[list_position(names, 'feats')], ''), u) as feats, nullif(nullif(fields[list_position(names, 'freq')], ''), u) as freq from x),
    z as (select *, case when tag then case when not tag_ok then 'quoting' end when not sound then 'quoting' when len(fields) <> len(names) then 'column_count'
                 when regexp_matches(array_to_string(fields, ''), '[\x00-\x1f\x{fffd}]') or (list_contains(names, 'word') and (word = '' or word = u)) or pos not in ('N', 'V', 'A', 'D', 'P', 'R', 'C', 'X')
                      or not regexp_full_match(feats, '\|(?:[^|]+\|)*', 's') or not regexp_full_match(freq, '0*[1-9][0-9]*') then 'value' end as reason from y)"""

SQL = {
    "p5_found": LINES + " select line_id, reason from z where reason is not null",
    "p5_loaded": LINES + " select line_id, run_id, word, pos, lemma, feats, freq::bigint::varchar as freq from z where reason is null and not tag",
    "p1_found": """
        with n as (select corpus, id, count(distinct cpos) as n from tokens where id is not null group by 1, 2)
        select distinct s.corpus, s.id from id_streams s left join n using (corpus, id)
        where s.id is not null and s.id_freq is not null and s.id_freq <> coalesce(n.n, 0)""",
    "p1_key_runs": """
        with t as (select corpus, id, cpos, cpos - lag(cpos) over (partition by corpus, id order by cpos) as gap
                   from tokens where corpus is not null and id is not null)
        select corpus, id, count(*) as n_rows, count(distinct cpos) as n_positions, min(cpos) as first_pos,
               max(cpos) as last_pos, coalesce(max(gap), 0) as max_gap from t group by 1, 2""",
}
