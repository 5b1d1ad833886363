import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessella.llm.encodings import RUN, Rules, find_garbled, garbled_documents, restore
from tessella.llm.leaks import Automaton, find_leaks, mask, remove_leaks, words
from tessella.llm.mixing import _queue, count_tokens, mix, shares

DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


def test_words_as_read():
    assert words("[[a|Bee]]s '''b'''old <b>x</b>y<br/>z &eacute;t&#233;&nbsp;&amp;q <!-- gone -->") == ["bees", "bold", "xy", "z", "été", "q"]
    assert words('{| class="w"\n|-\n| one || two\n|}\n[http://x.example/y label] {{t|arg=v}} FRÜSS früß') == ["one", "two", "label", "t", "arg", "v", "früss", "früss"]
    assert words("ét­e") == words("éte")
    assert words("") == [] and words("...") == []
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab <>[]{}|'&;#\n-!é=/") for _ in range(rng.randrange(60)))
        assert len(mask(t)) == len(t)


def test_automaton_against_brute_force():
    rng = random.Random(4)
    for least in (2, 3, 5):
        for _ in range(60):
            items = [(i, [rng.choice("abc") for _ in range(rng.randrange(0, 14))]) for i in range(rng.randrange(1, 6))]
            grams = defaultdict(set)
            for i, w in items:
                for k in range(len(w) - least + 1):
                    grams[tuple(w[k : k + least])].add(i)
            auto = Automaton(items, least)
            doc = [rng.choice("abcd") for _ in range(40)]
            got = {at: set(auto.items[level]) for at, level in auto.ends(doc)}
            want = {k + least - 1: grams[tuple(doc[k : k + least])] for k in range(len(doc) - least + 1) if tuple(doc[k : k + least]) in grams}
            assert got == want


def test_leaks(spark):
    item = "One two three four five six seven eight nine ten"
    docs = [
        (1, "x '''one''' two, [[q|three]] four\n| five || SIX <i>seven</i>&nbsp;eight y"), (2, "one two three four five six seven"), (3, None), (4, ""),
        (5, item + " " + item), (1, "x one two three four five six seven eight"), (6, "word " * 40000 + item), (None, item), (7, "pad " * 30 + item + " tail " * 30),
    ]
    d = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(3)).withColumn("longest", F.lit("x"))
    i = spark.createDataFrame([(9, item), (10, None), (11, "too short"), (12, item), (None, item)], ITEMS)
    want = {(a, b) for a in (1, 5, 6, 7) for b in (9, 12)}
    for block in (200_000, 11):  # one automaton, or one per item
        rows = find_leaks(d, i, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
        assert {r.matched for r in rows if r.doc_id == 5} == {20}
    assert find_leaks(d, i.limit(0)).collect() == [] and find_leaks(d.limit(0), i).collect() == []
    clean = {(r.doc_id, r.text, r.dropped) for r in remove_leaks(d, i, remove_from=10).collect()}
    assert (5, None, True) in clean and (3, None, False) in clean and (4, "", False) in clean
    seven = next(t for k, t, _ in clean if k == 7)
    assert "nine" not in seven and seven.count("tail") == 30 and seven.count("pad") == 30


def test_leaks_are_removed_by_any_number_of_blocks(spark):
    a, b = " ".join(f"a{k}" for k in range(14)), " ".join(f"b{k}" for k in range(14))
    items = spark.createDataFrame([(1, a), (2, b), (3, a + " " + b)], ITEMS)
    pad = " pad" * 60
    docs = spark.createDataFrame([(1, a + pad + " " + b), (2, "x " + a + " " + b + pad), (2, None), (3, ""), (4, "pad pad"), (5, a)], DOCS)
    one, many = (sorted(map(str, remove_leaks(docs, items, block_words=n).collect())) for n in (200_000, 14))
    assert one == many and len(many) == 6 and sum("removed_words=28" in r for r in many) == 2


def test_leaks_against_brute_force_for_any_block(spark):
    """Long and short items, repeated ids, copies of texts; blocks smaller than an item, and a filter that is full."""
    from tessella.llm import filters, leaks

    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(12)]
    texts = [(k % 5, [rng.choice(vocab) for _ in range(rng.randrange(2, 60))]) for k in range(7)]
    docs = [(k, [rng.choice(vocab) for _ in range(40)] + rng.choice(texts)[1][: rng.randrange(40)] + [rng.choice(vocab) for _ in range(9)]) for k in range(30)]
    docs += docs[:3] + [(99, docs[0][1])]
    least = 4
    want = []
    for d, w in docs:
        for i in {i for i, _ in texts}:
            grams = {tuple(t[k : k + least]) for j, t in texts if j == i for k in range(len(t) - least + 1)}
            ends = [k for k in range(len(w) - least + 1) if tuple(w[k : k + least]) in grams]
            if ends:
                spans = []
                for k in ends:
                    if spans and spans[-1][1] == k + least - 2:
                        spans[-1][1] = k + least - 1
                    else:
                        spans.append([k, k + least - 1])
                want.append((d, i, max(z - a + 1 for a, z in spans), len({x for a, z in spans for x in range(a, z + 1)}), max(len(t) for j, t in texts if j == i), len(w)))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], DOCS)
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in texts], ITEMS)
    cleaned = []
    for block, bits, share in ((200_000, 28, 100_000), (7, 28, 50), (4, 3, 100_000)):
        before = filters.MOST_BITS, leaks.SHARE
        filters.MOST_BITS, leaks.SHARE = bits, share
        try:
            assert sorted(map(tuple, find_leaks(d, i, least, block).collect())) == sorted(want), (block, bits)
            cleaned.append(sorted(map(str, remove_leaks(d, i, least, 6, 0.6, block).collect())))
        finally:
            filters.MOST_BITS, leaks.SHARE = before
    assert len(cleaned[0]) == len(docs) and cleaned[0] == cleaned[1] == cleaned[2]


def test_mix_reaches_shares_and_keeps_caps(spark):
    rng = random.Random(2)
    rows = [(k, s, rng.randrange(1, 20)) for k, s in enumerate(["big"] * 600 + ["mid"] * 150 + ["small"] * 40)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([(1, "big", 0.5, 1), (1, "mid", 0.3, 2), (1, "small", 0.2, 8), (2, "big", 0.9, 1), (2, "gone", 0.1, 3), (3, "big", None, 1), (4, "small", 1.0, None)], "mix_id bigint, source string, target_share double, max_repeats bigint")
    mixed = _queue(counted, targets, None, 7).cache()
    there = defaultdict(int)
    for _, s, n in rows:
        there[s] += n
    total = {1: int(min(there["big"] / 0.5, there["mid"] * 2 / 0.3, there["small"] * 8 / 0.2)), 2: there["big"], 4: there["small"]}
    got = defaultdict(lambda: defaultdict(int))
    repeats = defaultdict(int)
    for r in mixed.collect():
        got[r.mix_id][r.source] += r.n_tokens
        repeats[r.mix_id, r.source] = max(repeats[r.mix_id, r.source], r.repeat + 1)
    assert got.keys() == {1, 2, 4}
    for m, want in (({"big": 0.5, "mid": 0.3, "small": 0.2}), 1), ({"big": 1.0}, 2), ({"small": 1.0}, 4):
        m, want = (want, m) if isinstance(m, dict) else (m, want)
        all_ = sum(got[m].values())
        assert total[m] - 20 <= all_ <= total[m]
        for s, w in want.items():
            assert abs(got[m][s] - w * all_) <= 20
    assert repeats[1, "big"] == 1 and repeats[1, "mid"] <= 2 and repeats[1, "small"] <= 8 and repeats[4, "small"] == 1
    assert mixed.groupBy("mix_id", "doc_id", "repeat").count().filter("count > 1").count() == 0
    first = targets.filter("mix_id = 1")
    less = _queue(counted, first, 1000, 7)
    assert 980 <= less.agg(F.sum("n_tokens")).first()[0] <= 1000
    # a budget beyond the smaller sources' reach is filled by the others; exact shares go first if asked
    caps = {"big": there["big"], "mid": 2 * there["mid"], "small": 8 * there["small"]}
    assert caps["mid"] / 0.3 < caps["big"] / 0.5
    for budget in (total[1] + 500, sum(caps.values()) - 300, sum(caps.values()) + 9999):
        sums = {r.source: r.n for r in _queue(counted, first, budget, 7).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        aim = min(budget, sum(caps.values()))
        assert aim - 20 <= sum(sums.values()) <= aim and all(sums[s] <= caps[s] for s in caps)
        short = {s for s in caps if sums[s] < caps[s] - 20}
        assert all(abs(sums["big"] / 0.5 - sums[s] / w) <= 120 for s, w in (("mid", 0.3), ("small", 0.2)) if {"big", s} <= short)
    assert _queue(counted, first, total[1] + 500, 7, True).agg(F.sum("n_tokens")).first()[0] <= total[1]
    one = spark.createDataFrame([(k, "long" if k else "short", 10) for k in range(1001)], counted.schema)
    half = spark.createDataFrame([(1, "long", 0.5, 1), (1, "short", 0.5, 1)], targets.schema)
    got = {(r.source, r.tokens, round(r.share, 3), r.target_share) for r in shares(_queue(one, half, 5000, 7), half).collect()}
    assert got == {("long", 4990, 0.998, 0.5), ("short", 10, 0.002, 0.5)}
    reached = {(r.mix_id, r.source): r.share for r in shares(mixed, targets).collect()}
    assert reached[2, "gone"] == 0.0 and reached[2, "big"] == 1.0 and reached[3, "big"] == 0.0


def test_mix_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a", "one two"), (2, None, "x"), (3, "a", None), (4, "a", ""), (None, "a", "x")], "doc_id bigint, source string, text string").withColumn("finish", F.lit(1)).withColumn("w", F.lit(2))
    targets = spark.createDataFrame([(1, "a", 1.0, 2)], "mix_id bigint, source string, target_share double, max_repeats bigint")
    rows = mix(docs, targets).collect()
    assert sorted((r.doc_id, r.repeat) for r in rows if r.doc_id == 1) == [(1, 0), (1, 1)] and {r.doc_id for r in rows} <= {1, 4}
    assert mix(docs.limit(0), targets).collect() == [] and mix(docs, targets.limit(0)).collect() == []
    counted = {r.doc_id: r.n_tokens for r in count_tokens(docs.filter("doc_id is not null").select("doc_id", "text")).collect()}
    assert counted == {1: 2, 2: 1, 3: None, 4: 0}


def garble(s, written, read):
    return s.encode(written).decode(read)


BASE = ["Der frühe Vogel fängt den großen Wurm über Köln nach Mitternacht.", "Une forêt très éloignée, où l’été s’achève déjà près de Besançon.", "The café opens at 10 °C — said the naïve guest, ‘maybe’ with 5 € left."]


def test_garbled(spark):
    clean = [(k, BASE[k % 3] + f" Part {k // 3}.") for k in range(60)]
    for k in range(60, 66):
        clean.append((k, "Café naïve naïve früher Köln Été Noël · © ½ ½ Ñandú ┌─┐ ± 5"))
    cases = {
        100: (garble(BASE[0], "utf-8", "cp1252"), BASE[0]), 101: (garble(BASE[1], "utf-8", "latin-1"), BASE[1]), 102: (garble(BASE[0], "cp1252", "cp437"), BASE[0]),
        103: (garble(garble(BASE[0], "utf-8", "latin-1"), "utf-8", "latin-1"), BASE[0]), 104: (garble(BASE[0], "utf-8", "mac_roman"), BASE[0]), 105: (BASE[0].encode("cp1252").decode("utf-8", "replace"), None),
        106: (garble(BASE[0], "utf-8", "latin-1").replace("Ã¼", "&Atilde;&frac14;"), BASE[0]), 107: (garble(BASE[0], "cp1252", "cp437") + " twice", None), 108: ("A late caf" + garble("é", "utf-8", "cp1252") + " here.", "A late café here."),
        109: (garble(BASE[1], "utf-8", "cp437"), BASE[1]), 110: (garble(BASE[1], "utf-8", "cp437") + " again", None), 111: (garble(BASE[0], "utf-8", "mac_roman") + " again", None),
    }
    rows = clean + [(k, t) for k, (t, _) in cases.items()] + [(200, None), (201, ""), (None, "Ã¼")]
    df = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("own")).withColumn("key", F.lit(1))
    found = find_garbled(df, usual=0.01).cache()
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == set(cases)
    restored = {r.doc_id: (r.restored, r.whole) for r in restore(df, found).collect()}
    for k, (_, want) in cases.items():
        if want:
            assert restored[k][0] == want, k
    assert not restored[105][1] and restored[100][1]
    assert garbled_documents(df.limit(0)).collect() == []


def test_mappings_that_no_listed_encodings_explain_are_learned(spark):
    """Read as an encoding outside the rules' list: taught by a few twins, applied to documents without one."""
    told = ["Он вышел из дома, и снег всё ещё шёл над городом", "Мальчик долго смотрел в окно, потом взял книгу", "Зимой здесь рано темнеет, и улицы пусты"]
    more = ["Над городом шёл снег, мальчик вышел из дома", "Потом он долго смотрел на улицы и взял книгу"]
    rows = [(k, (told + more)[k % 5] + f", part {k % 15} of the long book, told again") for k in range(30)]
    twins = [(100 + 10 * n + k, garble(rows[k][1], w, "cp775")) for n, w in enumerate(("utf-8", "cp1251")) for k in range(8)]
    lone = [(200 + 10 * n + k, garble(t + f", a page of its own, number {k}{n}.", w, "cp775"), t) for n, w in enumerate(("utf-8", "cp1251")) for k, t in enumerate(more)]
    # edits between near-twins that are no garbling: words, accents, dashes
    edits = [(300, "Он вошёл в дома, и снег всё ещё лёг над городом, part 0 of the long book, told again"), (301, "Une forêt très éloignée, où l’été s’achève déjà, loin d’ici"), (302, "Une forêt très éloignée, où l’été s’achève déjà, loin d’ici"), (303, "Une forét trés èloignèe, où l’èté s’achéve dèjà, loin d’ici")]
    df = spark.createDataFrame(rows + twins + [x[:2] for x in lone] + edits, DOCS)
    found = find_garbled(df, usual=0.01).cache()
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == {k for k, *_ in twins + lone}
    origins = {(r.rule, r.origin) for r in found.select("rule", "origin").distinct().collect()}
    assert ("learned>runs", "learned") in origins and ("learned>words", "learned") in origins
    restored = {r.doc_id: r for r in restore(df, found).collect()}
    for k, _, clean in lone:
        # letters that no twin showed often enough stay, and are owned up to
        right = set(restored[k].restored.split()) & set(clean.split())
        assert len(right) >= 3 and (restored[k].whole == restored[k].restored.startswith(clean)), restored[k]


def test_restores_what_was_garbled_repeatedly(spark):
    russian, greek = "Он вышел из дома, и снег всё ещё шёл над городом.", "Η θάλασσα ήταν ήσυχη και το πλοίο έφυγε νωρίς."
    rows = [(k, (russian, greek, BASE[0])[k % 3] + f" Part {k // 3} of the long book, told again.") for k in range(30)]
    cases = {}
    for k, (text, read, times) in enumerate([(russian, "latin-1", 1), (russian, "latin-1", 2), (greek, "latin-1", 2), (russian, "latin-1", 3), (BASE[0], "latin-1", 4), (BASE[0], "latin-1", 5)]):
        clean = text + f" Part {k} of the long book, told again."
        bad = clean
        for _ in range(times):
            bad = garble(bad, "utf-8", read)
        cases[100 + k] = (bad, clean)
    df = spark.createDataFrame(rows + [(k, t) for k, (t, _) in cases.items()], DOCS)
    maps = [(k, r, Rules(["utf-8>latin-1"]).undo_multi(r, frozenset(map(chr, range(128, 0x600)))), "utf-8>latin-1") for k, (t, _) in cases.items() for r in set(RUN.findall(t)) if len(r) > 1]
    found = spark.createDataFrame([(k, r, hit[0], hit[1]) for k, r, hit, _ in maps if hit], "doc_id bigint, word string, clean string, rule string")
    got = {r.doc_id: (r.restored, r.whole) for r in restore(df, found).collect()}
    assert got == {k: (clean, True) for k, (_, clean) in cases.items()}


def test_whole_is_false_where_a_run_stays_garbled(spark):
    text = "Der " + garble("früh", "utf-8", "latin-1") + " und " + garble(garble("ŵ", "utf-8", "latin-1"), "utf-8", "latin-1") + " hier."
    df = spark.createDataFrame([(1, text)], DOCS)
    found = spark.createDataFrame([(1, "Ã¼", "ü", "utf-8>latin-1"), (1, "Ã\x85Âµ", "Å\xb5", "utf-8>latin-1")], "doc_id bigint, word string, clean string, rule string")
    assert [tuple(r) for r in restore(df, found).collect()] == [(1, "Der früh und Åµ hier.", False)]


def test_controls_within_words_are_restored(spark):
    texts = {1: ("\x93Hello\x94 he said, don\x92t.", "“Hello” he said, don’t.", True), 2: ("A \x81 stays", "A \x81 stays", False), 3: ("\x93Hi\x94 and \x8d.", "“Hi” and \x8d.", False), 4: ("half â\x80 here", "half â\x80 here", False), 5: ("caf\xe9\x94 \x97 x", "café” — x", True)}
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in texts.items()], DOCS)
    found = find_garbled(df)
    assert {r.doc_id: (r.restored, r.whole) for r in restore(df, found).collect()} == {k: (c, w) for k, (_, c, w) in texts.items()}


def test_rules_undo_what_they_do():
    rules = Rules()
    for n in rules.multi:
        once = rules.forwards(n, "éüß")
        assert rules.undo_multi(once, frozenset("éüß"))[0] == "éüß", n
    assert "cp1252>cp437" in rules.single
    assert rules.between(rules.forwards("cp1252>cp437", "ü"), "ü") >= {"cp1252>cp437"}
    assert rules.undo_multi("ãç", frozenset("é")) is None
