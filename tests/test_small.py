import pytest
from pyspark.sql import functions as F

from tessella.functions import identifiers
from tessella.functions.random import Multicarry
from tessella.model import Corpus, result
from tessella.operators import alignment, display, intervals
from tessella.sources import registry


def test_random():
    a, b = Multicarry(42), Multicarry(42)
    xs = [a.random() for _ in range(1000)]
    assert xs == [b.random() for _ in range(1000)] and all(0 <= x < 2**32 for x in xs) and len(set(xs)) > 990
    assert Multicarry(0, 0).state() == (1, 1)
    s = Multicarry(7).sample(5, 30)
    assert len(s) == 5 and s == sorted(set(s)) and s[-1] < 30


def test_registry():
    e = registry.read('NAME "A corpus"\nID news\nHOME /data # here\n##:: language = "en"\nATTRIBUTE word\nSTRUCTURE s\nALIGNED other\nDYNAMIC d(STRING):STRING "cmd $1"\n')
    assert (e.name, e.id, e.home, e.properties, e.attributes, e.structures, e.aligned) == ("A corpus", "news", "/data", {"language": "en"}, ["word"], ["s"], ["other"])
    assert registry.read(e.write()) == e
    for bad in ("NAME x\n", "ID x\nODD y\n", "ID x\nATTRIBUTE 9a\n", "ID x\nATTRIBUTE .a\n"):
        with pytest.raises(registry.RegistryError):
            registry.read(bad)
    assert all(map(identifiers.is_valid, ("a.b-c_1", "_x", "Z"))) and not any(map(identifiers.is_valid, ("", ".a", "-a", "1a", "aé", "a b")))
    assert identifiers.upper("aé-b") == "Aé-B" and identifiers.lower("ÀB") == "Àb"


def test_views(spark):
    t = spark.createDataFrame([(c, i, w) for c, ws in (("S", "abcd"), ("T", "wxyz")) for i, w in enumerate(ws)], "corpus string, cpos bigint, word string")
    r = spark.createDataFrame([("S", "s", 0, 0, 1, None), ("S", "s", 1, 2, 3, None)], "corpus string, satt string, struc bigint, start bigint, end bigint, value string")
    beads = spark.createDataFrame([("S", "T", 0, 0, 1, 0, 2)], "source string, target string, bead bigint, s1 bigint, s2 bigint, t1 bigint, t2 bigint")
    c = Corpus.build(t, r, ("word",), ("s",), beads)
    a = result(spark.createDataFrame([("S", 0, 1), ("S", 3, 3)], "corpus string, match bigint, matchend bigint"))
    assert {tuple(x) for x in alignment.aligned_text(a, beads, c).collect()} == {("S", 0, 1, "w x y"), ("S", 3, 3, None)}
    assert {x.line for x in display.decode_horizontal(c, ["word"], "s").collect()} == {"a b", "c d"}
    one = a.filter("match = 3")
    assert {(x.corpus, x.match) for x in intervals.complement(c.tokens, one).collect()} == {("S", 0), ("S", 1), ("S", 2), *(("T", k) for k in range(4))}
    with pytest.raises(Exception, match="single"):
        intervals.complement(c.tokens, a).collect()
    m = spark.createDataFrame([("K", "a"), ("J", "a"), ("K", "b")], "class string, token string")
    assert {(x.word, x["class"]) for x in display.class_columns(t.filter("corpus = 'S'"), m, "word").collect()} == {("a", "J"), ("b", "K"), ("c", None), ("d", None)}
    rows = [{"source": "a&b", "target": "x", "freq": 3}]
    assert all("3" in display.render_groups(rows, k)[0] for k in display.MODES)
