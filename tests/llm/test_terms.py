import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import pytest

from tessella.llm.pairs import associations, basket_items
from tessella.llm.terms import counted_entries, distinctiveness, last_seen_counts, term_frequencies, top_terms

LEX = "id bigint, att string, name string, name_len bigint"
TERMS = "entry_id bigint, corpus string, text_id bigint, id bigint, name string, freq bigint, loaded_at timestamp"


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([(i, "word", f"w{i}", 2) for i in range(30)] + [(100 + i, "category", f"k {i}", 3) for i in range(400)], LEX).cache()


def entries(n, seed):
    rng = random.Random(seed)
    t0 = datetime(2020, 1, 1)
    rows = []
    for e in range(n):
        i = 0 if rng.random() < 0.4 else rng.randrange(30)
        for k in range(rng.choice([1, 1, 2])):
            spelled = rng.choice([f"w{i}", f" W{i} ", f"w{i}  "])
            rows.append((e, rng.choice("AB"), rng.randrange(25), rng.choice([i, i, None]), rng.choice([spelled, spelled, None]), rng.choice([1, 2, 9, 0, None]), t0 + timedelta(seconds=k)))
    return rows


def counted(rows):
    held = {}
    for r in sorted(rows, key=lambda r: r[6]):
        held[r[0]] = r
    out = defaultdict(Counter)
    for _, corpus, text, i, name, freq, _ in held.values():
        if i is None and name:
            i = int(name.strip().lower()[1:])
        if i is not None and freq and freq >= 1:
            out[corpus, text][i] += freq
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_against_brute_force(spark, lexicon, seed):
    rows = entries(400, seed)
    df = spark.createDataFrame(rows, TERMS)
    texts = counted(rows)
    n = Counter(c for c, _ in texts)
    cf, df_ = defaultdict(Counter), defaultdict(Counter)
    for (c, _), t in texts.items():
        for i, f in t.items():
            cf[c][i] += f
            df_[c][i] += 1
    want = {(c, i): (cf[c][i], df_[c][i], n[c], "common" if df_[c][i] * 10 > n[c] else "rare" if df_[c][i] < 3 or cf[c][i] < 5 else None) for c in cf for i in cf[c]}
    got = {(r.corpus, r.id): (r.cf, r.df, r.n, r.mark) for r in term_frequencies(df, lexicon).collect()}
    assert got == want
    mu = 50.0
    total = {c: sum(cf[c].values()) for c in cf}
    for r in distinctiveness(df, lexicon, mu=mu, min_df=2).collect():
        t = texts[r.corpus, r.text_id]
        q = cf[r.corpus][r.id] / total[r.corpus]
        p = (t[r.id] + mu * q) / (sum(t.values()) + mu)
        assert r.df >= 2 and r.freq == t[r.id]
        assert math.isclose(r.divergence, p * math.log(p / q), abs_tol=1e-12)
    best = set()
    for (c, x), t in texts.items():
        ranked = sorted((-round(f * math.log(n[c] / df_[c][i]), 6), f"w{i}") for i, f in t.items())
        best |= {(c, x, name) for s, name in ranked[:3] if s < 0}
    scored = distinctiveness(df, lexicon, min_df=1, scores=("tfidf",))
    assert "divergence" not in scored.columns
    assert {(r.corpus, r.text_id, r.name) for r in top_terms(scored, lexicon, "tfidf").collect()} == best


def test_terms_edge_cases(spark, lexicon):
    t = datetime(2020, 1, 1)
    rows = [
        (1, "A", 1, None, None, 3, t), (2, "A", 1, None, "  ", 3, t), (3, "A", 1, None, "nowhere", 3, t), (4, "A", None, 1, None, 3, t), (5, None, 1, 1, None, 3, t),
        (6, "A", 1, 1, None, 3, None), (6, "A", 1, 1, None, 3, None), (6, "A", 1, 1, None, 3, None), (None, "A", 1, 1, None, 2, t), (None, "A", 1, 1, None, 2, t), (7, "A", 1, 2, "x" * 50000, -1, t),
    ]
    df = spark.createDataFrame(rows, TERMS).selectExpr("*", "'own' as w", "1 as k0")
    got = [tuple(r) for r in term_frequencies(df, lexicon).collect()]
    assert got == [("A", 1, 7, 1, 1, "common")]
    # one of ten texts is exactly a tenth: not above it, however the share is written
    tenth = spark.createDataFrame([(None, "B", k, 1 if k == 0 else 2, None, 9, t) for k in range(10)], TERMS)
    for share, want in ((0.1, {1: "rare", 2: "common"}), ("1/10", {1: "rare", 2: "common"}), (0.09, {1: "common", 2: "common"}), ("9/10", {1: "rare", 2: None}), (0.9, {1: "rare", 2: None})):
        assert {r.id: r.mark for r in term_frequencies(tenth, lexicon, share).collect()} == want
    assert term_frequencies(df.limit(0), lexicon).collect() == []
    assert distinctiveness(df.limit(0), lexicon).collect() == []


def test_last_seen_counters_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("A", t % 40, i, 1) for t in range(120) for i in range(4)]
        df = spark.createDataFrame(rows, "corpus string, text_id bigint, id bigint, freq bigint")
        assert {tuple(r) for r in last_seen_counts(df).collect()} == {("A", i, 120, 40) for i in range(4)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counted_entries_columns(spark, lexicon):
    assert counted_entries(spark.createDataFrame(entries(20, 3), TERMS), lexicon).columns == ["corpus", "text_id", "id", "freq"]


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_associations_against_brute_force(spark, chunk):
    rng = random.Random(chunk)
    baskets = {t: set(rng.sample(range(12), rng.choice([1, 2, 3]))) for t in range(60)}
    baskets[0] = set(range(12))  # every item
    for t in range(50, 60):
        baskets[t] = {20, 21, 22, 23, 24, 25, t}
    rows = [("A", t, i) for t, x in baskets.items() for i in x]
    df = spark.createDataFrame(rows, "corpus string, text_id bigint, id bigint")
    n, single, pair = len(baskets), Counter(), Counter()
    for x in baskets.values():
        single.update(x)
        pair.update(combinations(sorted(x), 2))
    for least, lift in ((5, 4.0), (1, 0.0), (2, 1.5)):
        want = {(a, b): k for (a, b), k in pair.items() if k >= least and k * n >= lift * single[a] * single[b]}
        got = {(r.id_a, r.id_b): r.n_ab for r in associations(df, least, lift, chunk).collect()}
        assert got == want


def test_basket_items_edge_cases(spark, lexicon):
    rows = [("A", 1, 100, None), ("A", 1, None, " K 0"), ("A", 1, None, None), (None, 1, 100, None), ("A", None, 100, None), ("A", 2, None, "k 1 ")]
    df = spark.createDataFrame(rows, "corpus string, text_id bigint, id bigint, name string").selectExpr("*", "1 as m", "2 as _salt")
    assert {tuple(r) for r in basket_items(df, lexicon).collect()} == {("A", 1, 100), ("A", 2, 101)}
    assert associations(basket_items(df.limit(0), lexicon)).collect() == []
