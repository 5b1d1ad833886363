import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators.skew import key_runs, running_sum, weighted_join
from tessella.operators.streams import stream_report
from tessella.sources.lines import read_lines, reclassify, valid_lines


def brute_runs(rows):
    by = defaultdict(list)
    for k, o in rows:
        by[k].append(o)
    out = {}
    for k, os in by.items():
        pos = sorted({o for o in os if o is not None})
        gaps = [b - a for a, b in zip(pos, pos[1:], strict=False)]
        out[k] = (len(os), len(pos), pos[0] if pos else None, pos[-1] if pos else None, max(gaps, default=0) if pos else None)
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_key_runs_against_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, *range(40)]) if rng.random() < 0.5 else 7) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, o bigint").withColumn("part", F.lit(1)).withColumn("n_rows", F.lit("x"))
    got = {r.k: tuple(r)[1:] for r in key_runs(df, ["k"], "o", n=parts).collect()}
    assert got == brute_runs(rows)


def test_key_runs_empty_and_only_null_order(spark):
    empty = spark.createDataFrame([], "k string, o bigint")
    assert key_runs(empty, ["k"], "o").collect() == []
    one = spark.createDataFrame([("a", None), ("a", None)], "k string, o bigint")
    assert [tuple(r) for r in key_runs(one, ["k"], "o").collect()] == [("a", 2, 0, None, None, None)]


def test_heavy_key_is_split(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), (F.col("id") % 3).alias("o"))
    from tessella.operators.skew import _ranged

    sizes = [n for n in _ranged(df, ["k"], "o", 8, True).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert len(sizes) >= 6 and max(sizes) < 8000
    assert tuple(key_runs(df, ["k"], "o", n=8).first()) == ("hot", 20000, 3, 0, 2, 1)


def test_running_sum(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.choice([None, 1, 2, 5])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").withColumn("part", F.lit("kept"))
    got = {(r.k, r.o): r.s for r in running_sum(df, ["k"], ["o"], "v", "s", n=5).collect()}
    want, sums = {}, defaultdict(int)
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        sums[k] += v or 0
        want[k, o] = sums[k]
    assert got == want
    assert "part" in running_sum(df, ["k"], ["o"], "v", "s").columns


def test_scratch_tables_are_removed(spark):
    import os

    from tessella.session import cut, scratch

    df = spark.range(5)
    with scratch(spark):
        with scratch(spark):
            inner = cut(df).inputFiles()[0]
        outer = cut(df).inputFiles()[0]
        assert not os.path.exists(inner.removeprefix("file://")) and os.path.exists(outer.removeprefix("file://"))
    assert not os.path.exists(outer.removeprefix("file://"))
    assert cut(df).count() == 5


def test_weighted_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("c%d" % i, i) for i in range(50)] + [(None, 1)], "k string, x bigint")
    right = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("w"), F.max("x").alias("m"))
    joined = weighted_join(left, right, ["k"], "w", ["x"], salts=4)
    assert joined.count() == 550 and joined.filter("k = 'hot'").count() == 500
    assert weighted_join(left, right, ["k"], "w", ["x"], how="left", salts=4).count() == 551


def test_stream_report(spark):
    tokens = spark.createDataFrame([("c", 0, 1), ("c", 0, 1), ("c", 1, 1), ("c", 2, None), (None, 3, 1), ("c", 4, 2)], "corpus string, cpos bigint, id bigint")
    streams = spark.createDataFrame([("c", 1, 2), ("c", 1, None), ("c", 2, 3), ("c", 3, 0), ("c", 4, 1), ("c", 5, None), ("c", 2, 1)], "corpus string, id bigint, id_freq bigint")
    got = {r.id: (r.n_positions, r.wrong) for r in stream_report(tokens, streams).collect()}
    assert got == {1: (2, False), 2: (1, True), 3: (0, False), 4: (0, True), 5: (0, False)}
    assert stream_report(tokens.limit(0), streams.limit(0)).collect() == []


RUNS = [
    (1, "\t", "__UNDEF__", None, "word pos lemma freq"),
    (2, ",;", "?", '"', "word lemma pos"),
    (3, "\t", "NA", None, "word feats"),
    (3, "\t", "NA", None, "word feats"),
    (4, ",;:!/*+-=%&@^~_()[]", "?", '"', "word pos"),
]
LINES = [
    (1, "a\tN\ta\t3", None), (1, "a\tN\ta", "column_count"), (1, "a\tQ\ta\t3", "value"), (1, "\tN\ta\t3", "value"), (1, "__UNDEF__\tN\ta\t3", "value"),
    (1, "a\t__UNDEF__\t\t007", None), (1, "a\tN\ta\t0", "value"), (1, "a\tN\ta\t٣", "value"), (1, 'a"b\tN\t"\t1', None), (1, "a\x07\tN\ta\t1", "value"),
    (1, "", "column_count"), (1, None, "column_count"), (1, "a\tN\ta\t" + "9" * 60, None), (1, "�\tN\ta\t1", "value"), (1, "< b\tN\ta\t1", None),
    (2, '"a,""b""",x,N', None), (2, 'a"b,x,N', "quoting"), (2, '"a"b,x,N', "quoting"), (2, '"a,x,N', "quoting"), (2, '"",x,N', "value"), (2, 'a;"";N', None),
    (2, "a,,", None), (2, "a,x,N,", "column_count"), (2, '"a\tb",x,N', "value"), (2, '""""; ;V', None), (2, '"?",x,N', "value"), (2, '"' + '""' * 30000 + '",x,N', None),
    (3, "a\t|", None), (3, "a\t|x|y|", None), (3, "a\t|x||", "value"), (3, "a\t||", "value"), (3, "a\tx|", "value"), (3, "a\tNA", None), (3, "a\t|" + "x|" * 30000, None),
    (1, "</s >", None), (1, '<s a="1" b=\'x\' c=3/>', None), (1, '<s a="1"b="2">', "quoting"), (1, "<s a=>", "quoting"), (1, "<!x", None), (1, "<?", None), (1, "</s x>", "quoting"),
    (1, "<s" + ' a="1"' * 20000 + ">", None), (1, "<s a>", "quoting"), (1, "<s / >", None), (9, "a", "settings"),
    *((4, f"dog{c}N", None) for c in ",;:!/*+-=%&@^~_()[]"), (4, "dog]N[", "column_count"), (4, '"d]g"]N', None), (4, "dog~Q", "value"),
]


def test_lines(spark):
    lines = spark.createDataFrame([(i, r, t, "own") for i, (r, t, _) in enumerate(LINES)], "line_id bigint, run_id bigint, raw_line string, kind string")
    runs = spark.createDataFrame(RUNS, "run_id bigint, field_separators string, undef_value string, quote_char string, column_names string")
    read = read_lines(lines, runs)
    got = {r.line_id: r.reason for r in reclassify(read).collect()}
    assert got == {i: x for i, (_, _, x) in enumerate(LINES) if x}
    loaded = {r.line_id: r for r in valid_lines(read).collect()}
    assert loaded.keys() == {i for i, (_, _, x) in enumerate(LINES) if not x}
    by_text = {LINES[i][1]: r for i, r in loaded.items()}
    assert by_text['"a,""b""",x,N'].record.word == 'a,"b"' and by_text['""""; ;V'].record.word == '"'
    assert by_text["a\t__UNDEF__\t\t007"].record.freq == 7 and by_text["a\t__UNDEF__\t\t007"].record.pos is None
    assert by_text["a\tN\ta\t" + "9" * 60].record.freq is None and by_text["a\tN\ta\t" + "9" * 60].fields[3] == "9" * 60
    assert {r.record.word for i, r in loaded.items() if LINES[i][0] == 4} == {"dog", "d]g"} and {r.record.pos for i, r in loaded.items() if LINES[i][0] == 4} == {"N"}
    assert all(r.in_kind == "own" for r in loaded.values())
    assert reclassify(read_lines(lines.limit(0), runs)).count() == 0
