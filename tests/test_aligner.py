from pyspark.sql import functions as F

from tessella.model import Corpus
from tessella.operators.aligner import Features, align
from tessella.queries_reference import QUERIES
from tessella.streaming.events import live_ngrams, windowed_counts


def build(spark, name, texts):
    rows, regions, at, s = [], [], 0, 0
    for t, sentences in enumerate(texts):
        begin = at
        for words in sentences:
            regions.append((name, "s", s, at, at + len(words) - 1, None))
            s += 1
            for w in words:
                rows.append((name, at, w))
                at += 1
        regions.append((name, "text", t, begin, at - 1, f"t{t}"))
    return Corpus.build(spark.createDataFrame(rows, "corpus string, cpos bigint, word string"), spark.createDataFrame(regions, "corpus string, satt string, struc bigint, start bigint, end bigint, value string"), ("word",), ("s", "text"))


def test_align(spark):
    a = build(spark, "A", [["alpha beta gamma".split(), "delta epsilon".split(), "zeta eta theta iota".split()], [["kappa"], ["lambda", "mu"]]])
    b = build(spark, "B", [["alpha beta gamma".split(), "delta epsilon zeta eta theta iota".split()], [["kappa"], ["lambda", "mu"]]])
    for by in ("ordinal", "value"):
        got = sorted(tuple(r)[2:7] for r in align(a, b, by=by).collect())
        assert got == [(0, 2, 0, 2, "1:1"), (3, 8, 3, 8, "2:1"), (9, 9, 9, 9, "1:1"), (10, 11, 10, 11, "1:1")]
    words = spark.createDataFrame([("kappa", "kappa")], "source string, target string")
    assert align(a, b, features=Features(pairs=9), word_list=words).count() == 4
    lone = build(spark, "C", [[["x"], ["y"]]])
    assert {r.kind for r in align(lone, b).collect()} <= {"1:1", "0:1", "1:0", "2:1", "1:2", "2:2"}


def test_align_every_pair(spark):
    texts = {"A": [["alpha beta gamma".split(), "delta epsilon".split()]], "B": [["alpha beta gamma".split(), "delta epsilon".split()], [["kappa"]]], "C": [["alpha beta gamma delta epsilon".split()], [["kappa"]]]}
    c = [build(spark, k, t) for k, t in texts.items()]
    every = Corpus(c[0].tokens.union(c[1].tokens).union(c[2].tokens), c[0].regions.union(c[1].regions).union(c[2].regions), ("word",), ("s", "text"))
    pairs = spark.createDataFrame([("A", "B"), ("B", "C"), ("B", "C")], "source string, target string")
    got = {tuple(r) for r in align(every, every, corpora=pairs).collect()}
    assert got == {tuple(r) for x, y in ((c[0], c[1]), (c[1], c[2])) for r in align(x, y).collect()}
    assert {(r[0], r[1]) for r in got} == {("A", "B"), ("B", "C")} and ("B", "C", 5, 5, 5, 5, "1:1") in {r[:7] for r in got}


def test_sentences_of_all_neighbours(spark, tmp_path):
    tokens = [(k, n, f"word{n}", "N", f"word{n}") for k in ("K1", "K2", "K3") for n in range(4)]
    regions = [(k, "s", s, 2 * s, 2 * s + 1, None) for k in ("K1", "K2", "K3") for s in range(2)] + [(k, "text", 0, 0, 3, "t") for k in ("K1", "K2", "K3")]
    spark.createDataFrame(tokens, "corpus string, cpos bigint, word string, pos string, lemma string").write.parquet(str(tmp_path / "tokens.parquet"))
    spark.createDataFrame(regions, "corpus string, satt string, struc bigint, start_cpos bigint, end_cpos bigint, region_value string").write.parquet(str(tmp_path / "regions.parquet"))
    got = {tuple(r)[:7] for r in QUERIES["align_sentences"](spark, str(tmp_path)).collect()}
    assert got == {(a, b, 2 * s, 2 * s + 1, 2 * s, 2 * s + 1, "1:1") for a, b in (("K1", "K2"), ("K2", "K3")) for s in range(2)}


def test_stream_extensions(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "view" if i % 2 else "click", 1.0) for i in range(50)]
    events = spark.createDataFrame(rows, "event_id bigint, t string, event_type string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    batch = {tuple(r) for r in windowed_counts(events).collect()}
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == batch
    tokens = spark.createDataFrame([("A", 0, "x"), ("A", 0, "x"), ("A", 1, "x")], "corpus string, cpos bigint, word string")
    assert [tuple(r) for r in live_ngrams(tokens).collect()] == [("A", "x", 2)]


def test_best_path_against_brute_force():
    import random
    from collections import Counter
    from functools import cache

    from tessella.operators.aligner import STEPS, _beads

    rng = random.Random(5)
    f = Features(shared=7, split=0)
    for _ in range(40):
        x, y = ([(10 * k, 10 * k + 9, rng.randrange(20), Counter({("w", rng.choice("abcdef"), 7): rng.randrange(1, 3) for _ in range(3)})) for k in range(rng.randrange(1, 9))] for _ in range(2))

        def like(i, di, j, dj, x=x, y=y):
            a, b = (sum((s[3] for s in side[k : k + d]), Counter()) for side, k, d in ((x, i, di), (y, j, dj)))
            return min(sum(s[2] for s in x[i : i + di]), sum(s[2] for s in y[j : j + dj])) + 7 * sum((a & b).values())

        @cache
        def best(i, j, x=x, y=y):
            if i == len(x) and j == len(y):
                return 0
            return max(best(i + di, j + dj) + (like(i, di, j, dj) if di and dj else 0) for di, dj in STEPS if i + di <= len(x) and j + dj <= len(y))

        beads = _beads(x, y, f)
        assert sum(b[5] for b in beads) == best(0, 0)
        starts = [b[:2] for b in beads if b[1] >= b[0]]
        assert [p for a, z in starts for p in range(a, z + 1)] == [p for s in x for p in range(s[0], s[1] + 1)]
        assert sum(b[5] for b in _beads(x, y, Features(shared=7, split=0, beam=1))) <= best(0, 0)
    assert _beads([(0, 9, 5, Counter())], [(k, k, 1, Counter()) for k in range(300)], Features(beam=2))[-1][3] == 299
