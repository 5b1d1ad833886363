import random

import pytest
from pyspark.sql import functions as F

from tessella.model import Corpus, result
from tessella.operators import access, alignment, cooccur, display, frequency, intervals, refine, sequence
from tessella.plans.language import Parser, QuerySyntaxError, parse
from tessella.plans.macros import MacroError, Macros
from tessella.plans.predicates import BindError
from tessella.plans.session import Facade, session

M1 = "the big red dog saw a cat . Dogs run fast .".split()
P1 = "D A A N V D N P N V R P".split()
M2 = "A x A x B x C x B x C".split()


def corpus(spark, name, words, pos=None, regions=(), beads=None):
    t = spark.createDataFrame([(name, i, w, (pos or words)[i]) for i, w in enumerate(words)], "corpus string, cpos bigint, word string, pos string")
    r = spark.createDataFrame([(name, s, k, a, b, v) for s, k, a, b, v in regions], "corpus string, satt string, struc bigint, start bigint, end bigint, value string")
    return Corpus.build(t, r, ("word", "pos"), tuple(sorted({x[0] for x in regions})), beads)


@pytest.fixture(scope="module")
def m1(spark):
    c = corpus(spark, "M1", M1, P1, [("s", 0, 0, 7, "1"), ("s", 1, 8, 11, "2"), ("np", 0, 0, 3, None), ("np", 1, 5, 6, None), ("np", 2, 8, 8, None)])
    c.tokens.cache()
    return c


@pytest.fixture(scope="module")
def m2(spark):
    return corpus(spark, "M2", M2)


def pairs(df):
    return sorted((r.match, r.matchend) for r in df.select("match", "matchend").collect())


def ask(c, text, **kw):
    return pairs(sequence.run(c, parse(text), **kw))


N = '[pos="N"]'


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f'[pos="A"]? [pos="A"]? {N} within s', {"traditional": [(1, 3), (2, 3), (3, 3), (6, 6), (8, 8)], "standard": [(1, 3), (6, 6), (8, 8)], "shortest": [(3, 3), (6, 6), (8, 8)], "longest": [(1, 3), (6, 6), (8, 8)]}),
        ('[pos="A"] [pos!="P"]* within s', {"traditional": [(1, 1), (2, 2)], "standard": [(1, 1), (2, 2)], "shortest": [(1, 1), (2, 2)], "longest": [(1, 6)]}),
        (f'[pos="D"] [pos="A"]* {N} within s', {k: [(0, 3), (5, 6)] for k in ("traditional", "standard", "shortest", "longest")}),
        (f'{N} [pos="V"]? within s', {"traditional": [(3, 3), (6, 6), (8, 8)], "standard": [(3, 3), (6, 6), (8, 8)], "shortest": [(3, 3), (6, 6), (8, 8)], "longest": [(3, 4), (6, 6), (8, 9)]}),
    ],
)
def test_strategies(m1, text, want):
    for strategy, expected in want.items():
        assert ask(m1, text, strategy=strategy) == expected, strategy


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('[pos="P"] []', [(7, 8)]), ('[pos="P"] [] within s', []), ('(?longest) <np> []* </np>', [(0, 3), (5, 6), (8, 8)]), ('"DOG"%c', [(3, 3)]), ('"dogs?"%c', [(3, 3), (8, 8)]),
        ('"do"', []), ('"^dog"', []), (f'{N} :: match.word = "cat"', [(6, 6)]), (f'a:[pos="D"] []* b:{N} :: dist(a,b) = 1 within s', [(5, 6)]), ('<s> []', [(0, 0), (8, 8)]), ('[] </s>', [(7, 7), (11, 11)]),
        ('<s = "2"> [] []', [(8, 9)]), (f'{N} [: pos="V" :]', [(3, 3), (8, 8)]), ('[np]', [(i, i) for i in (0, 1, 2, 3, 5, 6, 8)]), ('[lbound(s)]', [(0, 0), (8, 8)]), ('[f(pos) = 1]', [(10, 10)]), ('a:[pos="A"] [pos = a.pos]', [(1, 2)]),
        ('[word="." & _.s = "2"]', [(11, 11)]), ('[] within 1 s cut 2', [(0, 0), (1, 1)]), ('"dog" []* "fast" within 2 s', [(3, 10)]), ('"dog" []{0,3} "cat" within 2', []), ('"dog" []{0,3} "cat" within 3', [(3, 6)]), ('["the|a"] | "fast"', [(0, 0), (5, 5), (10, 10)]),
        ('[!(word = "the") & !(pos = "N")] within s', [(i, i) for i in (1, 2, 4, 5, 7, 9, 10, 11)]), ('[pos="A" -> word="red"] "saw"', [(3, 4)]), ('"dog" expand to s', [(0, 7)]), ('("the" | "a") []{1,2} [pos="N"] within s', [(0, 3)]),
    ],
)
def test_queries(m1, text, want):
    assert ask(m1, text) == want


def test_dynamic_attributes(m1):
    from dataclasses import replace

    c = replace(m1, functions={"tail": lambda x, n: F.right(x, n.cast("int"))})
    assert ask(c, '[tail(word, 2) = "og"] | [tail(word, 1) = "s"]') == [(3, 3), (8, 8)]


def test_targets_and_errors(m1):
    rows = sequence.run(m1, parse(f'[pos="D"] @[pos="A"] @1[] {N}')).collect()
    assert [(r.match, r.target, r.keyword) for r in rows] == [(0, 1, 2)]
    for bad in ('[pos="N"', "[]{3,2}", "[word contains]", 'TAB [] "a"', "(?odd) []"):
        with pytest.raises(QuerySyntaxError):
            parse(bad)
    for bad in ("[]*", "[nothing]", '[word < "a"]', "[pos = 3]", "[word = $gone]", "[] within nowhere"):
        with pytest.raises(BindError):
            sequence.run(m1, parse(bad))


def brute(words, pattern, start_bound):
    """All (start, end) by trying every end with the pattern as a regex over one letter per token."""
    import re

    text = "".join(words)
    return {i: [j for j in range(i, min(len(words), start_bound(i) + 1)) if re.fullmatch(pattern, text[i : j + 1])] for i in range(len(words))}


def test_random_patterns_against_brute_force(spark):
    rng = random.Random(7)
    words = [rng.choice("abc") for _ in range(60)]
    c = corpus(spark, "R", words, None, [("s", k, 12 * k, 12 * k + 11, None) for k in range(5)])
    c.tokens.cache()

    def make(depth):
        k = rng.random()
        if depth == 0 or k < 0.3:
            w = rng.choice("abc.")
            return ("[]" if w == "." else f'"{w}"'), w
        parts = [make(depth - 1) for _ in range(2)]
        if k < 0.55:
            return " ".join(p[0] for p in parts), "".join(p[1] for p in parts)
        if k < 0.7:
            return f"({parts[0][0]} | {parts[1][0]})", f"(?:{parts[0][1]}|{parts[1][1]})"
        q = rng.choice(["?", "+", "*", "{1,2}", "{2}"])
        return f"({parts[0][0]}){q}", f"(?:{parts[0][1]}){q}"

    tried = 0
    while tried < 12:
        query, regex = make(3)
        import re

        if re.fullmatch(regex, ""):
            continue
        tried += 1
        ends = brute(words, regex, lambda i: 12 * (i // 12) + 11)
        first = {(i, e[0]) for i, e in ends.items() if e}
        last = {(i, e[-1]) for i, e in ends.items() if e}
        longest = sorted((a, b) for a, b in last if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in last))
        assert ask(c, query + " within s", strategy="longest") == longest, query
        shortest = sorted((a, b) for a, b in first if not any(a <= x and y <= b and (x, y) != (a, b) for x, y in first))
        got = ask(c, query + " within s", strategy="shortest")
        assert got == shortest, query


def engines(c, text, names, strategy="traditional", variables=None, **kw):
    q = parse(text)
    plan = sequence.build(q.pattern)
    raw = {e: sequence._matches(c, q, plan, variables or {}, strategy, None, kw.get("strict", True), (0, 1), 500, e) for e in names}
    return {e: sorted((r.match, r.matchend, r.target, r.keyword) for r in df.distinct().collect()) for e, df in raw.items()}


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (f'[pos="A"]? {N}', ("leads", "sweep", "simulation")), ('[] "cat"', ("leads", "sweep", "simulation")), ('"the" []{1,3} "saw" within s', ("leads", "sweep", "simulation")),
        ('a:[pos="A"]? @[] b:[pos=a.pos | pos="N"] :: a.pos = "A" -> b.pos = "N"', ("leads", "simulation")), ('a:[pos="D"] []{0,4} b:[pos="N"] :: dist(a,b) >= 2 & b.s = "1" within s', ("leads", "simulation")),
        ('<s> [] [: pos="A" :] []', ("leads", "simulation")), ('<np> []{1,4} </np> []', ("leads", "simulation")), ('[] </s>', ("leads", "simulation")), ('</np> []', ("leads", "simulation")),
        ('<np> [] <s>', ("leads", "simulation")), ('[]{1,2} [: pos="V" :] within s', ("leads", "sweep", "simulation")), ('a:[] [: lbound(s) & rbound(s, a) :] []', ("leads", "simulation")),
        ('[pos="A"]+ []{0,2} [pos="V"]', ("sweep", "simulation")), ('([pos="A"] | [pos="N"])+ within s', ("sweep", "simulation")), ('"zzz"+', ("sweep", "simulation")),
    ],
)
def test_engines_agree(m1, monkeypatch, text, names):
    from tessella import model

    for block in (50_000, 4):
        monkeypatch.setattr(model, "BLOCK", block)
        monkeypatch.setattr(sequence, "BLOCK", block)
        for strategy in ("traditional", "longest"):
            got = engines(m1, text, names, strategy)
            assert len(set(map(tuple, got.values()))) == 1, (strategy, got)


def test_rare_patterns_and_empty_blocks(spark, m1):
    other = corpus(spark, "M3", ["pad"] * 9, ["Z"] * 9, [("s", 0, 0, 4, None), ("s", 1, 5, 8, None)])
    both = Corpus(m1.tokens.drop("np_id", "np_start", "np_end", "np_value").unionByName(other.tokens), m1.regions.unionByName(other.regions), ("word", "pos"), ("s",))
    assert ask(both, '"dog"+ "zzz"') == [] and ask(both, '"dog"+ "saw"') == [(3, 4)] and ask(both, 'a:"dog" []* [pos = a.pos]') == [(3, 6)]
    assert ask(both, 'a:"zzz"+ [pos = a.pos] within s') == [] and ask(both, '"cat" [word != "dog"]+ "fast" within 2 s') == [(6, 10)]
    empty = Corpus(both.tokens.limit(0), both.regions.limit(0), both.patts, both.satts)
    assert ask(empty, '"dog"+') == [] and ask(empty, '"dog" "saw"') == [] and ask(empty, 'a:"dog"+ [pos = a.pos]') == []


def test_labels_with_patterns_functions_and_variables(m1):
    from dataclasses import replace

    v = {"v": {"d.g", "cat"}, "none": set()}
    for text, want in (
        ('a:[pos="A"] [] [word = RE($v) & pos != a.pos]', [(1, 3)]), ('a:[pos="A"] [word = RE($v) & pos != a.pos]', [(2, 3)]), ('a:[pos="V"]+ [] [word = RE($v)%c & pos != a.pos]', [(4, 6)]),
        ('a:[]+ [word = $v & pos = "N" & a.word = RE($v)] within s', []), ('a:[pos="A"]+ [a.word != RE($v)]', [(1, 2), (2, 3)]), ('a:[word != RE($none)]+ [a.word = "dog"]', [(0, 4)]),
    ):
        assert ask(m1, text, variables=v) == want, text
    c = replace(m1, functions={"tail": lambda x, n: F.right(x, n.cast("int"))})
    assert ask(c, 'a:[tail(word, 1) = "s"]+ [tail(a.word, 1) != tail(word, 1)]') == [(8, 9)] and ask(c, 'a:[] [tail(a.word, 2) = "og" & pos = "V"]') == [(3, 4)]


def test_regions_across_blocks(spark, m1, monkeypatch):
    from tessella import model

    want = sorted(map(str, m1.tokens.collect()))
    monkeypatch.setattr(model, "BLOCK", 4)
    monkeypatch.setattr(model, "HALO", 3)
    regions = m1.regions.unionByName(m1.regions.filter("false"))
    c = Corpus.build(m1.tokens.select("corpus", "cpos", "word", "pos"), regions, ("word", "pos"), ("np", "s"))
    columns = m1.tokens.columns
    assert sorted(map(str, c.tokens.select(columns).collect())) == want
    stored = c.stored("small")
    assert sorted(map(str, stored.tokens.select(columns).collect())) == want
    rows = stored.blocks.collect()
    assert {(r._block, r.cpos) for r in rows} == {(b, p) for b in range(3) for p in range(max(0, 4 * b - 1), min(12, 4 * b + 7))} | {(3, 11)}
    assert {str(r) for r in stored.blocks.select(columns).distinct().collect()} == set(want) and all(r._own == (r.cpos // 4 == r._block) for r in rows)
    for text in ('[pos="A"]+ []* [pos="N"] within s', "<np> []{1,5} </np>"):
        assert ask(stored, text) == ask(m1, text)
    # inverted regions and regions of other attributes are left out; of overlapping ones the last start counts
    odd = spark.createDataFrame([("M1", "s", 0, 5, 2, "x"), ("M1", "z", 0, 0, 9, "x"), ("M1", "s", 1, 0, 6, "a"), ("M1", "s", 2, 5, 9, "b")], "corpus string, satt string, struc bigint, start bigint, end bigint, value string")
    got = {r.cpos: r.s_value for r in Corpus.build(m1.tokens.select("corpus", "cpos", "word"), odd, ("word",), ("s",)).tokens.collect()}
    assert got == {p: "a" if p < 5 else "b" if p < 10 else None for p in range(12)}


def test_delete_keeps_equal_rows(spark):
    a = ranges(spark, [(0, 1), (2, 3), (2, 3), (4, 4)])
    assert pairs(refine.delete_lines(a, 1)) == [(0, 1), (2, 3), (4, 4)] and pairs(refine.delete_lines(a, 0, 2)) == [(4, 4)]
    assert pairs(refine.cut(a, 1, 2)) == [(2, 3), (2, 3)] and refine.reduce(a, 3, seed=1).count() == 3 and refine.reduce(a, 20_000, seed=1).count() == 4


def test_boundary(m1):
    assert ask(m1, '"dog" []* "cat"', boundary=2) == [] and ask(m1, '"dog" []* "cat"', boundary=3) == [(3, 6)]
    assert ask(m1, '"the" []* "fast" within 100000') == [(0, 10)]


def test_stored_corpus(spark, m1):
    c = m1.stored("m1")
    assert c.longest == {"np": 4, "s": 8}
    for text in ('[pos="A"] [pos="N"]', '"the" []* "cat" within s', 'a:[pos="A"] []* [pos = a.pos] within s', "<np> []* </np>"):
        assert ask(c, text) == ask(m1, text)
    plan = sequence.run(c, parse('[pos="A"] [pos="N"]'), strategy="traditional")._jdf.queryExecution().toString()
    assert "Window" in plan and plan.split("== Physical Plan ==")[1].split("Window")[1].count("Exchange") == 0


def mu(c, text, **kw):
    return [m for m, _ in pairs(cooccur.run_mu(c, parse(text), **kw))]


def test_cooccurrence(m1, m2):
    assert mu(m2, 'MU(meet "C" "B" -3 -1)') == [6, 10]
    assert mu(m2, 'MU(meet "A" "B" -3 5)') == [0, 2] and mu(m2, 'MU(meet "A" "B" -3 5)', compat_edge=True) == []
    assert mu(m2, 'MU(meet "C" "B")') == [] and mu(m2, 'MU(union "A" "C")') == [0, 2, 6, 10]
    assert mu(m1, f'MU(meet {N} [pos="V"] s)') == [3, 6, 8] and mu(m1, 'MU(meet (meet "cat" "a" -1 -1) "saw" s) cut 1') == [6]
    tab = lambda t: pairs(cooccur.run_tab(m2, parse(t)))
    assert tab('TAB "A" * "B" * "C"') == [(0, 6)] and tab('TAB "B" {1} "C"') == [(4, 6), (8, 10)] and tab('TAB "A" {,2} "B"') == [(2, 4)]
    assert pairs(cooccur.run_tab(m1, parse('TAB "dog" * "fast" within s'))) == [] and pairs(cooccur.run_tab(m1, parse('TAB "saw" "a"'))) == [(4, 5)]


def ranges(spark, rows, name="I"):
    return result(spark.createDataFrame([(name, a, b) for a, b in rows], "corpus string, match bigint, matchend bigint"))


def test_pruning(spark, monkeypatch):
    base = [(0, 2), (0, 4), (1, 4), (3, 4), (5, 9), (6, 7)]
    a = ranges(spark, base)
    assert pairs(intervals.minimal(a)) == [(0, 2), (3, 4), (6, 7)] and pairs(intervals.maximal(a)) == [(0, 4), (5, 9)]
    assert pairs(intervals.left_maximal(a)) == [(0, 2), (1, 4), (5, 9), (6, 7)] and pairs(intervals.non_overlapping(a)) == [(0, 2), (3, 4), (5, 9)]
    rng = random.Random(3)
    for block in (1 << 16, 8):  # small blocks: everything crosses borders
        monkeypatch.setattr(intervals, "BLOCK", block)
        for _ in range(3):
            rows = sorted({(s, s + rng.randrange(14)) for s in (rng.randrange(80) for _ in range(40))})
            a = ranges(spark, rows + rows[:5])
            inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and x != y
            assert pairs(intervals.maximal(a)) == [x for x in rows if not any(inside(x, y) for y in rows)]
            assert pairs(intervals.minimal(a)) == [x for x in rows if not any(inside(y, x) for y in rows)]
            kept, last = [], -1
            for s, e in rows:
                if s > last:
                    kept.append((s, e))
                    last = e
            assert pairs(intervals.non_overlapping(a)) == kept
    for gap in (1, 5, 9):  # chains that never meet, long elements over many blocks, and ends that nothing follows
        rows = sorted({(s, s + gap) for s in range(60)} | {(10, 44), (7, 70), (90, 91)})
        kept, last = [], -1
        for s, e in rows:
            if s > last:
                kept.append((s, e))
                last = e
        assert pairs(intervals.non_overlapping(ranges(spark, rows))) == kept
    assert pairs(intervals.maximal(ranges(spark, []))) == [] and pairs(intervals.non_overlapping(ranges(spark, []))) == []


def test_set_operations(spark):
    a, b = ranges(spark, [(0, 1), (2, 3), (2, 3)]).withColumn("target", F.lit(7).cast("long")), ranges(spark, [(2, 3), (4, 4)])
    assert sorted(((r.match, r.target) for r in intervals.union(a, b).collect()), key=lambda x: x[0]) == [(0, 7), (2, 7), (4, None)]
    assert pairs(intervals.union(a, b)) == [(0, 1), (2, 3), (4, 4)] and pairs(intervals.difference(a, b)) == [(0, 1)]
    assert set(pairs(intervals.intersection(a, b))) == {(2, 3)}
    assert pairs(intervals.containing(ranges(spark, [(0, 5), (6, 9)]), ranges(spark, [(5, 6), (7, 7)]))) == [(6, 9)]


def test_refinement(m1):
    a = sequence.run(m1, parse(N))
    tok = Parser('[pos="D"]')._token().test
    near = {r.match: r.target for r in refine.set_anchor_search(m1, a, "target", "nearest", tok, 3).collect()}
    assert near == {3: 5, 6: 5, 8: 5}
    assert {r.match: r.target for r in refine.set_anchor_search(m1, a, "target", "farthest", tok, 9, side="left").collect()} == {3: 0, 6: 0, 8: 0}
    assert {r.match: r.target for r in refine.set_anchor_search(m1, a, "target", "rightmost", tok, 1, "s").collect()} == {3: 5, 6: 5, 8: None}
    assert pairs(refine.expand(m1, a, 1, "np")) == [(0, 3), (5, 6), (8, 8)] and pairs(refine.expand(m1, a, 2)) == [(1, 5), (4, 8), (6, 10)]
    assert pairs(refine.expand(m1, a, 2, "s", "right")) == [(3, 11), (6, 11), (8, 11)]
    assert pairs(refine.cut(a, 2)) == [(3, 3), (6, 6)] and pairs(refine.cut(a, 1, 2)) == [(6, 6), (8, 8)] and pairs(refine.cut(a, 5, 4)) == []
    assert pairs(refine.delete_lines(a, 1)) == [(3, 3), (8, 8)] and refine.reduce(a, percent=50).count() == 1 and refine.reduce(a, 9).count() == 3
    b = refine.set_anchor(a, "target", "match")
    assert refine.delete_by_anchor(b, "target", True).count() == 0 and refine.size(b, "target").first().size == 3
    assert pairs(refine.subset(m1, a, "match", Parser('[word="cat"]')._token().test)) == [(6, 6)]
    assert pairs(refine.set_anchor(refine.set_anchor_search(m1, a, "target", "leftmost", tok, 9), "match", "target")) == [(0, 3), (0, 6), (0, 8)]
    with pytest.raises(ValueError):
        refine.set_anchor(a, "match", None)


def test_frequencies(m1):
    got = {(r.pos_0 + r.pos_1): r.freq for r in frequency.scan(m1, ["pos+0", "pos+1"]).collect()}
    assert got == {"AA": 1, "AN": 1, "DA": 1, "DN": 1, "NP": 1, "NV": 2, "PN": 1, "RP": 1, "VD": 1, "VR": 1}
    assert {(r.word_0, r.freq) for r in frequency.scan(m1, ["word", "?pos=/N/"]).collect()} == {("dog", 1), ("cat", 1), ("Dogs", 1)}
    assert {(r.s_0, r.freq) for r in frequency.scan(m1, ["s", "?np"]).collect()} == {("1", 6), ("2", 1)}
    assert frequency.scan(m1, ["word+0", "?word+1"], regular=True, start=0, end=8).count() == 7
    assert {(r.word, r.freq) for r in frequency.lexicon_export(m1, "word", "dogs?", "c").collect()} == {("dog", 1), ("Dogs", 1)}
    look = m1.tokens.sparkSession.createDataFrame([("dog",), ("none",)], "item string")
    assert {(r.word, r.freq) for r in frequency.lexicon_export(m1, "word", lookup=look, keep_unknown=True).collect()} == {("dog", 1), ("none", 0)}
    assert {r.word for r in frequency.lexicon_export(m1, "word", lookup=look).collect()} == {"dog"}
    a = sequence.run(m1, parse(N))
    assert {(r.source, r.target, r.freq) for r in frequency.group(m1, a, "match", "word").collect()} == {("(all)", w, 1) for w in ("dog", "cat", "Dogs")}
    assert {(r.source, r.target, r.freq) for r in frequency.group(m1, a, "match", "pos", ("target", "word")).collect()} == {("(none)", "N", 3)}
    order = lambda s: [r.match for r in s.orderBy("sort_rank").collect()]
    assert order(frequency.sort(m1, a, "word", reverse=True)) == [3, 8, 6] and order(frequency.sort(m1, a, "word", "c")) == [6, 3, 8]
    assert order(frequency.sort(m1, a, "word", descending=True)) == [3, 6, 8]
    rows = frequency.count(m1, sequence.run(m1, parse('[pos="P"] | [pos="N"]')), "word").collect()
    assert {(r.text, r.size, r["first"]) for r in rows} == {(".", 2, 0), ("Dogs", 1, 2), ("cat", 1, 3), ("dog", 1, 4)}


def test_display(m1):
    a = sequence.run(m1, parse('"a" "cat"'))
    r = display.tabulate(m1, a, [display.single("match"), display.Item(frequency.Span(), "word", "c"), display.single("matchend", "word", 9), display.single("target")]).first()
    assert (r.item_0, r.item_1, r.item_2, r.item_3) == ("5", "a cat", "", "-1")
    k = display.kwic(m1, a, 2, 1, "word").first()
    assert (k.left_context, k.node, k.right_context) == ("dog saw", "a cat", ".")
    k = display.kwic(m1, a, 6, 3).first()
    assert (k.left_context, k.right_context) == ("og saw", ". D")
    k = display.kwic(m1, a, 1, 1, "s").first()
    assert k.left_context == "the big red dog saw" and k.right_context == "."
    assert all("cat" in display.render([k], m)[0] for m in display.MODES)
    assert [tuple(r)[1:] for r in display.dump(a).collect()] == [(0, 5, 6, -1, -1)]
    lines = [r.line for r in display.decode(m1, ["word", "pos"], 8, 11, ["s"]).orderBy("cpos", "ord").collect()]
    assert lines == ["<s 2>", "Dogs\tN", "run\tV", "fast\tR", ".\tP", "</s>"]


def test_concordance(m1):
    a = sequence.run(m1, parse('@"dog" @1"saw"'))
    twice = a.unionByName(a)
    view = display.View(2, 1, "word", "np", ("word", "pos"), ("np",), targets=True, structures=("s",))
    rows = display.concordance(m1, twice, view).orderBy("line_no").collect()
    assert [(r.line_no, r.structures, r.left_context, r.node, r.right_context) for r in rows] == [(k, "<s 1>", "big/A red/A", "dog/N</np>(0) saw/V(1)", "") for k in (0, 1)]
    assert display.kwic(m1, twice, 1, 1, "word").count() == 2
    for mode in display.MODES:
        for table in (False, True):
            lines = [r.text for r in display.rendered(display.concordance(m1, a, view), mode, numbered=True, table=table).collect()]
            top, bottom = display.frame(mode, {"query": "a & b"}, table, True)
            assert len(lines) == 1 and "saw/V(1)" in lines[0] and ("</np>" in lines[0]) == (mode in ("ascii", "latex")) and len(top) + len(bottom) > 0
    assert display.tabulate(m1, twice, [display.single("target", "word"), display.single("keyword", "pos", 1)]).select("item_0", "item_1").collect() == [("dog", "D")] * 2


def test_alignment(spark):
    beads = spark.createDataFrame([("S", "T", 0, 0, 1, 0, 2), ("S", "T", 1, 2, 4, 3, 4), ("S", "T", 2, 6, 7, 5, 6)], "source string, target string, bead bigint, s1 bigint, s2 bigint, t1 bigint, t2 bigint")
    s, t = corpus(spark, "S", list("abcdefgh"), beads=beads), corpus(spark, "T", list("tuvwxyz"))
    win = {(r.match, r.matchend): (r._lo, r._hi) for r in alignment.windows(ranges(spark, [(0, 4), (4, 5), (1, 4)], "S"), beads).collect()}
    assert win == {(0, 4): (0, 4), (1, 4): (0, 4)}
    assert pairs(alignment.translate(ranges(spark, [(1, 4), (5, 5)], "S"), beads)) == [(0, 2)]
    q = sequence.run(s, parse('[] : T "x"'), others={"T": t})
    assert pairs(q) == [(2, 2), (3, 3), (4, 4)]
    assert pairs(sequence.run(s, parse('[] : T ! "x"'), others={"T": t})) == [(0, 0), (1, 1), (6, 6), (7, 7)]
    assert {(r.source_text, r.target_text) for r in alignment.bead_text(s, t).collect()} == {("a b", "t u v"), ("c d e", "w x"), ("g h", "y z")}


def test_access(m1):
    assert {(r.word, r.id) for r in access.str2id(m1, "word", ["the", "."]).collect()} == {("the", 0), (".", 7)}
    assert access.idlist2freq(m1, "word", [7]).first().freq == 2 and access.lexicon_size(m1, "pos").first().size == 6
    assert {tuple(r)[1:] for r in access.cpos2struc(m1, "s", [7, 8]).collect()} == {(7, 0, 0, 7, "1", 5), (8, 1, 8, 11, "2", 3)}
    assert [r.cpos for r in access.positions_in_order(m1, "word", ".").collect()] == [7, 11]


def test_access_by_table_and_all(spark, m1):
    some = spark.createDataFrame([("M1", 7), ("M1", 8), ("M1", 8), ("M2", 9), ("M1", 99)], "corpus string, cpos bigint").withColumn("word", F.lit("own"))
    assert sorted(tuple(r)[1:] for r in access.cpos2struc(m1, "s", some).collect()) == [(7, 0, 0, 7, "1", 5), (8, 1, 8, 11, "2", 3)]
    every = access.cpos2struc(m1, "s").collect()
    assert sorted(r.cpos for r in every) == list(range(12)) and {r.cpos for r in every if r.flags == 5} == {7, 11}


def test_macros():
    m = Macros()
    m.read("# c\nMACRO np(1)\n  [pos=\"D\"]? \"$0\"\n;\nMACRO two($0=a $1=b) /np[$0] \"$1\";\n")
    assert m.expand('/two["x", "y"] "/np[z]"').split() == '[pos="D"]? "x" "y" "/np[z]"'.split()
    assert m.expand("/region[np]") == "(<np> []* </np>)" and m.expand("/unify(f, a, b, c)") == "unify(a.f, unify(b.f, c.f))" and m.expand("/undef[a, b]") == "(ignore(~a) & ignore(~b))"
    m.define("loop", 0, "/loop[]")
    for bad in ("/loop[]", "/gone[1]", "/np[1"):
        with pytest.raises(MacroError):
            m.expand(bad)


def test_session_options_and_output(spark, m1, tmp_path):
    s = session({"M1": m1})
    s.run('set DefaultNonbrackAttr "pos"')
    assert pairs(s.run('"D" "N"')) == [(5, 6)] and pairs(s.run('["V"]')) == [(4, 4), (9, 9)]
    s.run('set da word; set hb 2; set HardCut 1')
    assert pairs(s.run('"dog" []* "cat"')) == [] and pairs(s.run(N)) == [(3, 3)]
    s.run("set hb 500; set hc 0")
    s.run('A = @"dog" @1"saw"; set Context 1 words; set LeftContext 1 np; set ShowTargets on; show +pos +np -cpos; set ps s')
    assert [r.text for r in s.run("cat A").collect()] == ["<s 1>:  big/A red/A".replace(":  ", ": <np>the/D ") + " <dog/N</np>(0) saw/V(1)> <np>a/D"]
    s.run("show -pos; show -np; set c 3; show +cpos; set st off; set ps none")
    assert [r.text for r in s.run("cat A").collect()] == ["        3: red <dog saw> a c"]
    s.run("set pm html; set po hdr")
    text = [r.text for r in s.run("cat A").orderBy("corpus", "line_no").collect()]
    assert text[-1] == "</ul>" and any("dog saw" in x and "<li>" in x for x in text) and any("query" in x for x in text)
    s.run("set pm ascii; set po none")
    assert s.run("show cd")["positional"] == {"word": True, "pos": False} and s.run("set hb") == {"hard_boundary": 500} and "pager" in s.run("show options")
    for bad in ("set Nothing 1", "set hb many", "set ShowTargets perhaps", "set ms odd", "set pm odd", "show +odd", "count A word"):
        with pytest.raises(QuerySyntaxError):
            s.run(bad)
    read = lambda n: [r.value for r in spark.read.text(str(tmp_path / n)).collect()]
    s.run(f"""B = [pos="N"]; cat A > "{tmp_path}/cat"; dump B > "{tmp_path}/dump"; tabulate B match word, match pos > '{tmp_path}/tab'; group B match word > "{tmp_path}/group"; count B by word > "{tmp_path}/count" """)
    assert read("cat") == ["        3: red <dog saw> a c"] and read("dump") == ["3\t3\t-1\t-1", "6\t6\t-1\t-1", "8\t8\t-1\t-1"] and read("tab") == ["dog\tN", "cat\tN", "Dogs\tN"]
    assert len(read("group")) == 3 and [x.split("\t")[0] for x in read("count")] == ["Dogs", "cat", "dog"]
    assert [r["first"] for r in s.run("count B by word desc").orderBy("text").collect()] == [2, 1, 0]
    with pytest.raises(QuerySyntaxError):
        s.run('cat A > "| sort"')
    s.run(f'undump U < "{tmp_path}/dump"; undump T with target keyword < "{tmp_path}/dump"')
    assert pairs(s.named("U")) == [(3, 3), (6, 6), (8, 8)] and s.named("T").filter("target is null").count() == 3
    (tmp_path / "words").write_text("dog\nbig red\n")
    s.run(f'define $v = "cat"; define $v += < "{tmp_path}/words"')
    assert s.run("show $v") == ["big red", "cat", "dog"]
    s.run("set sub on; [pos=\"D\"] [pos=\"A\"]+ [pos=\"N\"]")
    assert s.active == "Last" and pairs(s.run('[pos="A"]')) == [(1, 1), (2, 2)]
    f = Facade(session({"M1": m1}))
    assert pairs(f.query("M1", "Q", N)) == [(3, 3), (6, 6), (8, 8)] and f.list_subcorpora("M1") == ["Last", "Q"] and f.subcorpus_size("Q").first().size == 3
    assert not f.subcorpus_has_field("Q", "target") and f.subcorpus_has_field("Q", "match") and [r.match for r in f.dump_subcorpus("Q", "match", 1, 2).orderBy("line").collect()] == [6, 8]
    assert {(r.value, r.freq) for r in f.fdist_1("Q", 3, "match", "pos").collect()} == {("N", 3)} and f.fdist_2("Q", 1, "match", "pos", "match", "word").count() == 3
    f.drop_subcorpus("Q")
    assert f.list_subcorpora("M1") == ["Last"]


def test_session(m1):
    s = session({"M1": m1})
    assert pairs(s.run(f"A = {N}; B = [pos=\"P\"]; C = union A B")) == [(3, 3), (6, 6), (7, 7), (8, 8), (11, 11)]
    assert s.run("size C").first().size == 5
    s.run('define $v = "cat dog"; define $v += "run"; define $w = $v; define $w -= "cat"')
    assert s.run("show $w") == ["dog", "run"] and pairs(s.run("[word = $w]")) == [(3, 3), (9, 9)] and s.run("size $v") == 3
    assert pairs(s.run("A^np")) == [(0, 3), (5, 6), (8, 8)] and pairs(s.run("subset A where match: [word=\"cat\"]")) == [(6, 6)]
    assert [r.target for r in s.run("A = [pos=\"N\"]; set A target nearest [pos=\"D\"] within 3 words from match").orderBy("match").collect()] == [5, 5, 5]
    s.run("sort A by word %c")
    assert [r.match for r in s.run("dump A").orderBy("line").collect()] == [6, 3, 8]
    assert pairs(s.run("cut A 1")) == [(6, 6)]
    assert s.run("group Last match pos").count() == 1 and s.run("tabulate B match word, match").count() == 2
    s.run('set MatchingStrategy "longest"; define macro adj(1) \'[pos="A"]+ [word="$0"]\'')
    assert pairs(s.run('/adj["dog"]')) == [(1, 3)]
    assert pairs(s.run("D = <np> []* </np>; D; [pos=\"N\"]")) == [(3, 3), (6, 6), (8, 8)]
    s.run('set MatchingStrategy "standard"')
    s.active = "M1"
    assert {(r.source, r.target, r.freq) for r in s.run('/codist["dog|cat", pos]').collect()} == {("dog", "N", 1), ("cat", "N", 1)}
    assert "A" in s.run("show named") and s.run("info M1")["p_attributes"] == ["word", "pos"]
    s.run("discard A")
    with pytest.raises(QuerySyntaxError):
        s.run("size A")
