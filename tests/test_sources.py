import gzip

import pytest
from pyspark.sql import functions as F

from tessella.functions import featuresets, scalar
from tessella.functions.folding import fold, fold_text
from tessella.functions.regex import RegexError, matches, set_contains, set_matches
from tessella.model import Corpus, result
from tessella.sources import results, vertical
from tessella.sources.vertical import Structure

TEXT = """<?xml version="1.0"?>
<text id="t1" lang='en'>
<s>
the\tD\t|b|a|
a &amp; b\tX
<np>
big\tA\tx
<np>
dog\tN
</np>
</np>
</np>
<s>
</s>
<odd>
runs
</text>
<s>
<pb/>
end\tN\t|
<e/>
"""


@pytest.fixture(scope="module")
def encoded(spark):
    lines = spark.createDataFrame([("C", "f", i, x) for i, x in enumerate(TEXT.split("\n"))], "corpus string, file string, line_no bigint, raw string")
    structures = [Structure.parse("text+id+lang+none", valued=True), Structure.parse("s"), Structure.parse("np:1"), Structure.parse("e")]
    return vertical.encode(lines, ["word", "pos", "feats"], structures, null=["pb"], entities=True, sets=["feats"])


def test_encode(encoded):
    tokens, regions = encoded
    assert [tuple(r)[1:] for r in tokens.orderBy("cpos").collect()] == [
        (0, "the", "D", "|a|b|"), (1, "a & b", "X", "|"), (2, "big", "A", "|"), (3, "dog", "N", "|"), (4, "<odd>", "__UNDEF__", "|"), (5, "runs", "__UNDEF__", "|"), (6, "end", "N", "|"),
    ]
    got = {(r.satt, r.struc, r.start, r.end, r.value) for r in regions.collect()}
    assert got == {
        ("text", 0, 0, 5, "id=\"t1\" lang='en'"), ("text_id", 0, 0, 5, "t1"), ("text_lang", 0, 0, 5, "en"), ("text_none", 0, 0, 5, ""),
        ("s", 0, 0, 3, None), ("s", 1, 6, 6, None), ("np", 0, 2, 3, None), ("np1", 0, 3, 3, None),
    }


def test_encode_empty(spark):
    tokens, regions = vertical.encode(spark.createDataFrame([], "corpus string, file string, line_no bigint, raw string"), ["word"], [Structure("s")])
    assert tokens.count() == 0 and regions.count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "b.vrt").write_text("﻿two\r\n")
    with gzip.open(tmp_path / "a.vrt.gz", "wt") as f:
        f.write("one\nuno\n")
    rows = vertical.read_files(spark, str(tmp_path / "*.vrt*"), "C")
    assert [r.raw for r in rows.orderBy("file", "line_no").collect()] == ["one", "uno", "two"]


def test_large_and_odd_files(spark, tmp_path):
    words = [f"w{i}" for i in range(3000)]
    (tmp_path / "big.vrt").write_text("\n".join(words) + "\n\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = vertical.read_files(spark, str(tmp_path / "big.vrt"), "C")
        assert [r.raw for r in rows.orderBy("line_no").collect()] == [*words, "", "last"] and rows.agg(F.max("line_no")).first()[0] == 3001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "latin.vrt").write_bytes("é\nx\n".encode("latin-1"))
    at = str(tmp_path / "latin.vrt")
    assert [r.raw for r in vertical.read_files(spark, at, "C", "iso-8859-1").orderBy("line_no").collect()] == ["é", "x"]
    assert [r.raw for r in vertical.read_files(spark, at, "C", invalid="repair").orderBy("line_no").collect()] == ["\ufffd", "x"]
    with pytest.raises(Exception, match="not UTF-8"):
        vertical.read_files(spark, at, "C").collect()
    assert {(r.line_no, r.problem) for r in vertical.check_lines(vertical.read_files(spark, at, "C", invalid="keep")).collect()} == {(0, "encoding")}


def test_alignment_files(spark):
    raw = ["S s T s", "0 3\t0 4 1:1", "4 6 5 4", "7 9 5 9 2:1 77"]
    lines = spark.createDataFrame([("S", "f", i, x) for i, x in enumerate(raw)], "corpus string, file string, line_no bigint, raw string")
    assert [tuple(r) for r in vertical.read_beads(lines, "T").orderBy("bead").collect()] == [("S", "T", 0, 0, 3, 0, 4), ("S", "T", 1, 7, 9, 5, 9)]
    bad = lines.unionByName(spark.createDataFrame([("S", "f", 9, "8 10 10 12")], lines.schema))
    with pytest.raises(Exception, match="must ascend"):
        vertical.read_beads(bad, "T").collect()
    c = [Corpus.build(spark.createDataFrame([(k, i, "x") for i in range(6)], "corpus string, cpos bigint, word string"), spark.createDataFrame(r, "corpus string, satt string, struc bigint, start bigint, end bigint, value string"), ("word",), ("s", "text")) for k, r in (
        ("S", [("S", "text", 0, 0, 5, None), ("S", "s", 0, 0, 2, None), ("S", "s", 1, 3, 5, None)]), ("T", [("T", "text", 0, 0, 2, None), ("T", "text", 1, 3, 5, None), ("T", "s", 0, 0, 3, None), ("T", "s", 1, 4, 5, None)]))]
    got = {tuple(r) for r in vertical.check_pre_alignment(c[0], c[1], "s", "text").collect()}
    assert got == {("S", "T", None, "count"), ("T", "S", None, "count"), ("T", None, 0, "partition"), ("T", None, 1, "partition")}


def test_blocks_are_crossed(spark, monkeypatch):
    monkeypatch.setattr(vertical, "BLOCK", 3)
    df = spark.createDataFrame([("a", i) for i in (0, 1, 2, 7, 20)] + [("b", 4)], "k string, o bigint")
    got = {(r.k, r.o): r.n for r in vertical.next_in_order(df, ["k"], "o", F.col("o"), "n").collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", 2): 7, ("a", 7): 20, ("a", 20): None, ("b", 4): None}


def test_regions_and_beads(spark):
    rows = spark.createDataFrame([("C", 0, 4, "x"), ("C", 2, 3, "y"), ("C", 0, 5, "z"), ("C", 6, 6, None), ("C", 8, 7, "bad")], "corpus string, start bigint, end bigint, value string")
    merged = vertical.import_regions(rows, "s", "merge")
    assert {(r.struc, r.start, r.end, r.value) for r in merged.collect()} == {(0, 0, 5, "z"), (1, 6, 6, None)}
    assert {r.line for r in vertical.export_regions(merged, "s").collect()} == {"0\t5\tz", "6\t6"}
    with pytest.raises(Exception, match="overlapping region"):
        vertical.import_regions(rows, "s").collect()
    good = rows.filter("start in (6, 2)")
    assert {(r.struc, r.start, r.end) for r in vertical.import_regions(good, "s").collect()} == {(0, 2, 3), (1, 6, 6)}

    def merge(spans):
        df = spark.createDataFrame([("C", s, e, str(k), k) for k, (s, e) in enumerate(spans)], "corpus string, start bigint, end bigint, value string, line bigint")
        return sorted((r.start, r.end, int(r.value)) for r in vertical.import_regions(df, "s", "merge").collect())

    assert merge([(5, 10), (8, 20), (0, 6)]) == [(0, 6, 2)] and merge([(0, 6), (5, 10), (8, 20)]) == [(0, 6, 0), (8, 20, 2)]
    assert merge([(3, 4), (3, 4)]) == [(3, 4, 1)] and merge([(3, 4), (3, 3)]) == [(3, 4, 0)] and merge([(3, 4), (6, 7), (9, 9), (3, 6)]) == [(3, 6, 3), (9, 9, 2)]
    beads = spark.createDataFrame([("S", "T", 0, 1, 0, 2), ("S", "T", 2, 1, 3, 4)], "source string, target string, s1 bigint, s2 bigint, t1 bigint, t2 bigint")
    assert [tuple(r) for r in vertical.import_beads(beads, reverse=True).collect()] == [("T", "S", 0, 0, 2, 0, 1)]


def test_check_lines(spark):
    raw = ["a\tb", "a\tb", "", " a\tb", "a", "<s x=1>", "<s>", "</s>", "</s>", "a\tb\r"]
    lines = spark.createDataFrame([("C", "f", i, x) for i, x in enumerate(raw)], "corpus string, file string, line_no bigint, raw string")
    got = {(r.line_no, r.problem) for r in vertical.check_lines(lines).collect()}
    # the start tag in line 5 is malformed, yet a tag
    assert got == {(2, "empty"), (3, "leading_blank"), (4, "columns"), (5, "tag"), (9, "carriage_return")}

    def nesting(*tags):
        df = spark.createDataFrame([("C", "f", i, x) for i, x in enumerate(tags)], lines.schema)
        return {(r.line_no, r.problem) for r in vertical.check_lines(df).collect()}

    assert nesting("<a>", "<b>", "</b>", "<b>", "</b>", "</a>", "<c/>") == set()
    assert nesting("<a>", "<b>", "</a>", "</b>") == {(2, "crossing a"), (3, "crossing b")}
    assert nesting("</a>", "<a>") == {(0, "surplus a")} and nesting("<a>", "</a>", "</a>", "<b>", "</b>", "</c>") == {(2, "surplus a"), (5, "surplus c"), (None, "unbalanced a"), (None, "unbalanced c")} and nesting("<a>", "<b>", "</b>") == {(None, "unbalanced a")}


def test_results(spark, tmp_path):
    c = Corpus.build(spark.createDataFrame([("C", i, "x") for i in range(10)], "corpus string, cpos bigint, word string"), None, ("word",))
    rows = spark.createDataFrame([("C", 0, 5, 6, -1), ("C", 1, 0, 2, 1)], "corpus string, line bigint, match bigint, matchend bigint, target bigint")
    a = results.undump(c, rows)
    assert [(r.match, r.target, r.sort_rank) for r in a.orderBy("sort_rank").collect()] == [(5, None, 0), (0, 1, 1)]
    results.save(a, str(tmp_path / "r"))
    assert results.load(spark, str(tmp_path / "r")).count() == 2
    results.write_dump(a, str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ["5\t6\t-1\t-1", "0\t2\t1\t-1"]
    for bad in ([("C", 0, 5, 4, -1)], [("C", 0, 5, 10, -1)], [("D", 0, 0, 0, -1)], [("C", 0, 0, 0, 12)]):
        with pytest.raises(Exception, match="interval"):
            results.undump(c, spark.createDataFrame(bad, rows.schema)).collect()
    with pytest.raises(Exception, match="overlap"):
        results.undump(c, rows, ascending=True).collect()


def column(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*map(F.col, names)).alias("x")).first()
    return row.x


def test_functions(spark):
    c = lambda e, *v: column(spark, e, *v)
    assert c(featuresets.make_set, "|b|a|b|") == "|a|b|b|" and c(lambda x: featuresets.make_set(x, True), "a b") == "|a|b|" and c(featuresets.make_set, "a|b") is None
    assert c(featuresets.unify, "|a|b|", "|b|c|") == "|b|" and c(featuresets.ambiguity, "|") == 0 and c(featuresets.ambiguity, None) == 0
    assert c(featuresets.unify, None, "|b|") == "|b|"
    for f, args in ((featuresets.unify, ("|a|", None)), (featuresets.unify, ("a", "|b|")), (featuresets.ambiguity, ("a",))):
        with pytest.raises(Exception, match="malformed or undefined"):
            c(f, *args)
    assert c(featuresets.set_intersection, "|a|a|b|", "|a|a|c|") == "|a|a|" and c(featuresets.set_size, "x") == -1
    assert c(lambda x: set_contains(x, "a."), "|ab|cd|") is True and c(lambda x: set_matches(x, "a."), "|ab|cd|") is False
    assert c(scalar.to_int, "12abc") == 12 and c(scalar.to_int, "abc") == 0 and c(scalar.to_int, None) is None
    assert c(scalar.prefix, "lesson", "less") == "less" and c(scalar.minus, "lesson", "less") == "on" and c(scalar.is_prefix, "less", "lesson") == 1
    assert c(scalar.entity_decode, "&lt;&amp;lt;") == "<&lt;" and c(scalar.zap_controls, "a\tb") == "a?b"
    for flags in ("c", "d", "cd"):
        text = "Ångström Straße ﬁ ΣΊΣΥΦΟΣ ÀÉîõü ǅ"
        assert spark.createDataFrame([(text,)], "x string").select(fold(F.col("x"), flags).alias("y")).first().y == fold_text(text, flags)
    assert c(lambda x: fold(x, "cd"), "Ångström Straße ΣΣ") == "angstrom strasse σσ"
    assert c(lambda x: matches(x, "é.*[[:digit:]]", "c"), "ÉTÉ9") is True and c(lambda x: matches(x, "ete", "d"), "été") is True and c(lambda x: matches(x, "a", ""), "ab") is False
    assert c(lambda x: matches(x, "x\\.y", ""), "x.y\n") is False
    for bad in ("[[:odd:]]", "a(?R)", "("):
        with pytest.raises(RegexError):
            matches(F.col("x"), bad)


def test_result_columns(spark):
    assert result(spark.createDataFrame([("C", 1, 2)], "corpus string, match bigint, matchend bigint")).columns == ["corpus", "match", "matchend", "target", "keyword", "sort_rank"]
