"""Sequence queries: regular expressions over tokens.

A pattern becomes an automaton whose input symbols are its token tests, tags and
anchors. What a test says without labels is evaluated by Spark, one boolean per symbol
and token. Three ways lead from there to the matches:

* ``_leads``: patterns of bounded length. Each way through the automaton is a
  conjunction over ``lead`` columns; labels and targets are offsets in it.
* ``_Sweep``: unbounded patterns without labels, targets, tags or anchors. All starts
  of a block advance together, one numpy step per word of the longest match.
* ``_Simulation``: the rest, from each start by itself, in the blocks where a match may start.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.model import BLOCK, Corpus, result
from tessella.operators import intervals
from tessella.operators.ranges import point_in_interval
from tessella.operators.skew import weighted_join
from tessella.plans.language import Alt, Anchor, Bool, Query, Ref, Rel, Repeat, Seq, Tag, Tok, refs_of
from tessella.plans.predicates import AtOffsets, BindError, Compiler, Evaluator, calls_of, hoist

BOUNDARY = 500


@dataclass
class Plan:
    symbols: list = field(default_factory=list)
    steps: list[dict[int, int]] = field(default_factory=list)  # state: symbol -> state
    final: set[int] = field(default_factory=set)


def build(pattern: object) -> Plan:
    """Position automaton, made deterministic over its symbols."""
    symbols: list = []
    edges: list[list[tuple[int | None, int]]] = []

    def state() -> int:
        edges.append([])
        return len(edges) - 1

    def lay(node: object, a: int, where: dict[int, int]) -> int:
        """Lays ``node`` from state a on; copies of a repeated node keep its symbols."""
        if isinstance(node, Seq):
            for p in node.parts:
                a = lay(p, a, where)
            return a
        if isinstance(node, Alt):
            z = state()
            for p in node.parts:
                edges[lay(p, _fork(a), where)].append((None, z))
            return z
        if isinstance(node, Repeat):
            for _ in range(node.least):
                a = lay(node.of, a, where)
            if node.most is None:
                hub = state()
                edges[a].append((None, hub))
                edges[lay(node.of, hub, where)].append((None, hub))
                z = state()
                edges[hub].append((None, z))
                return z
            z = state()
            for _ in range(node.most - node.least):
                edges[a].append((None, z))
                a = lay(node.of, _fork(a), where)
            edges[a].append((None, z))
            return z
        if id(node) not in where:
            where[id(node)] = len(symbols)
            symbols.append(node)
        z = state()
        edges[a].append((where[id(node)], z))
        return z

    def _fork(a: int) -> int:
        b = state()
        edges[a].append((None, b))
        return b

    start = state()
    end = lay(pattern, start, {})

    def closed(states: frozenset[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s, t in edges[todo.pop()]:
                if s is None and t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    plan = Plan(symbols)
    numbers = {closed(frozenset({start})): 0}
    todo = list(numbers)
    plan.steps.append({})
    while todo:
        here = todo.pop(0)
        n = numbers[here]
        if end in here:
            plan.final.add(n)
        moves: dict[int, set[int]] = {}
        for q in here:
            for s, t in edges[q]:
                if s is not None:
                    moves.setdefault(s, set()).add(t)
        for s in sorted(moves):
            there = closed(frozenset(moves[s]))
            if there not in numbers:
                numbers[there] = len(numbers)
                plan.steps.append({})
                todo.append(there)
            plan.steps[n][s] = numbers[there]
    if 0 in plan.final:
        raise BindError("the pattern matches the empty sequence")
    return plan


@dataclass
class _Path:
    """One way through the automaton: its symbols, its final state, and how many tokens it takes."""

    symbols: tuple[int, ...]
    final: int
    size: int


def _paths(plan: Plan, numbers: tuple[int, int], most: int = 64, longest: int = 16) -> list[_Path] | None:
    """All ways through the automaton, or None if they are too many, too long, or meet in one
    state with other labels: there the simulation has to say which of them hold."""
    out: list[_Path] = []
    met: dict[tuple[int, int, int], dict] = {}
    todo: list[tuple[int, tuple[int, ...], int, dict]] = [(0, (), 0, {})]
    while todo:
        q, word, k, bound = todo.pop()
        if word and met.setdefault((word[0], k, q), bound) != bound:
            return None
        if q in plan.final and k:
            out.append(_Path(word, q, k))
        if len(out) > most or len(word) > longest or len(todo) > 10 * most:
            return None
        for s, t in plan.steps[q].items():
            sym, now = plan.symbols[s], dict(bound)
            if isinstance(sym, Anchor):
                return None
            if isinstance(sym, Tag):
                if sym.closing:
                    now.pop(("<", sym.name), None)
                else:
                    now["<", sym.name] = k
            elif isinstance(sym, Tok):
                if sym.label:
                    now[sym.label] = k
                if sym.marker in numbers:
                    now["target" if sym.marker == numbers[0] else "keyword"] = k
            todo.append((t, (*word, s), k + (isinstance(sym, Tok) and not sym.ahead), now))
    return out


def _free(node: object | None, corpus: Corpus) -> bool:
    """Whether a test can be evaluated without labels."""
    known = set(corpus.patts) | set(corpus.satts) | {"_"}
    return all(r.label in (None, "_") and not r.delete and r.name in known for r in refs_of(node)) and not any(len(c.args) > 1 and c.name in ("lbound", "rbound", "lbound_of", "rbound_of") for c in calls_of(node))


def _split(test: object | None, corpus: Corpus) -> tuple[object | None, object | None]:
    """What of a test can be evaluated without labels, and what remains."""
    if _free(test, corpus):
        return test, None
    if not (isinstance(test, Bool) and test.op == "&"):
        return None, test
    free, late = [a for a in test.args if _free(a, corpus)], [a for a in test.args if not _free(a, corpus)]
    join = lambda parts: None if not parts else parts[0] if len(parts) == 1 else Bool("&", tuple(parts))
    return join(free), join(late)


def with_frequencies(corpus: Corpus, tests: list, tokens: DataFrame | None = None) -> DataFrame:
    """Tokens with ``f_<att>`` for every f(att) in the tests; heavy values salted."""
    tokens = corpus.tokens if tokens is None else tokens
    for att in sorted({c.args[0].name for t in tests if t is not None for c in calls_of(t) if c.name == "f"}):
        freq = corpus.tokens.filter(F.col(att).isNotNull()).groupBy("corpus", att).agg(F.count("*").alias(f"f_{att}")).withColumn("_w", F.col(f"f_{att}"))
        tokens = weighted_join(tokens, freq, ["corpus", att], "_w", ["cpos"], how="left")
    return tokens


def _boundary(corpus: Corpus, within, tokens: DataFrame, boundary: int = BOUNDARY) -> tuple[DataFrame, Column, int | None]:
    """Tokens, the last position a match from each may reach (null: none may start), and the bound in words if there is one."""
    if within is None:
        return tokens, F.col("cpos") + boundary, boundary
    if within.satt is None:
        return tokens, F.col("cpos") + within.n, within.n
    if within.satt not in corpus.satts:
        raise BindError(f"unknown region {within.satt}")
    if within.n == 1:
        return tokens, F.col(f"{within.satt}_end"), None
    regions = corpus.regions.filter(F.col("satt") == within.satt).select("corpus", F.col("struc").alias("_n"), F.col("end").alias("_end"))
    last = regions.groupBy("corpus").agg(F.max("_n").alias("_last"))
    ids = tokens.select("corpus", F.col(f"{within.satt}_id").alias("_id")).filter("_id is not null").distinct()
    reach = ids.join(last, "corpus").withColumn("_n", F.least(F.col("_id") + within.n - 1, F.col("_last"))).join(regions, ["corpus", "_n"]).select("corpus", "_id", "_end")
    counts = tokens.groupBy("corpus", F.col(f"{within.satt}_id").alias("_id")).agg(F.count("*").alias("_w")).join(reach, ["corpus", "_id"])
    joined = weighted_join(tokens.withColumn("_id", F.col(f"{within.satt}_id")), counts, ["corpus", "_id"], "_w", ["cpos"], how="left").drop("_id")
    return joined.withColumnRenamed("_end", "_reach"), F.col("_reach"), None


def run(corpus: Corpus, query: Query, variables: dict[str, set[str]] | None = None, strategy: str = "standard", parents: DataFrame | None = None, strict: bool = True, numbers: tuple[int, int] = (0, 1), others: dict[str, Corpus] | None = None, boundary: int = BOUNDARY) -> DataFrame:
    """The result of a sequence query: (corpus, match, matchend, target, keyword, sort_rank).

    ``parents`` confines matches to the ranges of an earlier result (overlapping
    ones are pruned from the left first). ``strict`` ties a closing tag to the
    region its opening tag entered. ``numbers`` are the target markers that set
    target and keyword. ``others`` are corpora for alignment constraints.
    Without ``within``, a match ends at most ``boundary`` words after its start.
    Rows without a word still hold a position; null attributes match no test.
    """
    variables = variables or {}
    strategy = query.strategy or strategy
    plan = build(query.pattern)
    _bind_names(plan, query, corpus)
    found = _matches(corpus, query, plan, variables, strategy, parents, strict, numbers, boundary)
    for a in query.aligned:
        from tessella.operators.alignment import aligned_filter

        other = (others or {}).get(a.corpus)
        if other is None:
            raise BindError(f"unknown corpus {a.corpus}")
        hits = run(other, Query(a.pattern), variables, "traditional", boundary=boundary)
        found = aligned_filter(found, corpus.beads.filter(F.col("target") == a.corpus), hits, a.negated)
    found = intervals.prune(found, strategy)
    if query.cut is not None:
        from tessella.operators.refine import first_rows

        found = first_rows(found, ["match", "matchend"], query.cut)
    if query.keep and parents is not None:
        found = intervals.containing(parents, found)
    if query.expand is not None:
        from tessella.operators.refine import expand

        found = expand(corpus, found, query.expand.n, query.expand.satt, query.expand.side)
    return result(found)


def _bind_names(plan: Plan, query: Query, corpus: Corpus) -> None:
    """Every name must be an attribute or a label of the pattern, and every label be used."""
    tests = [s.test for s in plan.symbols if isinstance(s, Tok)] + [query.constraint]
    used = [r for t in tests if t is not None for r in refs_of(t)]
    labels = {s.label for s in plan.symbols if isinstance(s, Tok) and s.label}
    known = set(corpus.patts) | set(corpus.satts)
    points = labels | {"match", "matchend", "target", "keyword", "_"}
    for r in used:
        if r.label is not None and (r.label not in points or r.name not in known):
            raise BindError(f"unknown reference {r.label}.{r.name}")
        if r.label is None and r.name not in known | points:
            raise BindError(f"unknown attribute or label {r.name}")
    if idle := labels - {r.label for r in used} - {r.name for r in used}:
        raise BindError(f"labels that nothing refers to: {sorted(idle)}")


def _matches(corpus: Corpus, query: Query, plan: Plan, variables: dict, strategy: str, parents: DataFrame | None, strict: bool, numbers: tuple[int, int], boundary: int, engine: str | None = None) -> DataFrame:
    """Raw matches. ``engine`` is for tests that hold the three against each other."""
    symbols, within = plan.symbols, query.within
    if parents is None and any(isinstance(s, Anchor) for s in symbols):
        raise BindError("anchors need an active result")
    deletes = any(r.delete for s in symbols if isinstance(s, Tok) and s.test is not None for r in refs_of(s.test))
    paths = None if deletes else _paths(plan, numbers)
    late = [_split(s.test, corpus)[1] if isinstance(s, Tok) else None for s in symbols]
    simple = all(isinstance(s, Tok) and s.marker not in numbers for s in symbols) and not any(late) and query.constraint is None
    engine = engine or ("leads" if paths else "sweep" if simple else "simulation")
    tests = [s.test for s in symbols if isinstance(s, Tok)] + [query.constraint]
    # tokens of another region than the start's are looked at
    edges = any(isinstance(s, Tok) and s.ahead or not isinstance(s, Tok) for s in symbols)
    words = boundary if within is None else within.n if within.satt is None else None
    if engine == "leads":
        words = max(p.size for p in paths) + 1
    elif words is None and (longest := corpus.longest.get(within.satt)) is not None and within.n * longest + 2 <= BLOCK:
        words = within.n * longest
    tokens, whole = corpus.tokens, False
    if engine == "leads" and words == 2 and not edges:
        tokens = tokens.withColumns({"_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    elif words is not None:
        tokens = corpus.blocked(words + 2)
    elif within.n == 1 and not edges:
        # whole regions: a token goes to the block of its region's start
        tokens = tokens.filter(F.col(f"{within.satt}_id").isNotNull()).withColumns({"_block": F.floor(F.col(f"{within.satt}_start") / BLOCK), "_own": F.lit(True)})
    else:
        whole = True
    tokens, bound, _ = _boundary(corpus, within, with_frequencies(corpus, tests, tokens), boundary)
    compiler = Compiler(corpus.patts, corpus.satts, variables, functions=corpus.functions)
    bits = [_bit(s, corpus, compiler, variables).alias(f"t{i}") for i, s in enumerate(symbols)]
    own = [] if whole else ["_block", "_own"]
    rows = tokens.withColumn("_bound", bound)
    extra = []
    if parents is not None:
        spans = intervals.non_overlapping(parents).select("corpus", F.col("match").alias("_ps"), F.col("matchend").alias("_pe"), F.col("target").alias("_pt"), F.col("keyword").alias("_pk"))
        rows = point_in_interval(rows, "cpos", spans, "_ps", "_pe", "left").withColumn("_bound", F.when(F.col("_ps").isNotNull(), F.least("_bound", "_pe")))
        extra = ["_ps", "_pe", "_pt", "_pk"]
    if engine == "leads":
        return result(_leads(rows, query, plan, paths, late, bits, compiler, strategy, strict, numbers, edges))
    columns: dict[str, Column] = {}
    hoisted = [None if t is None else hoist(t, compiler, columns) for t in late]
    constraint = None if query.constraint is None else hoist(query.constraint, compiler, columns)
    tags = sorted({f"{s.name}_end" for s in symbols if isinstance(s, Tag)})
    rows = rows.select("corpus", "cpos", *own, "_bound", *bits, *[c.alias(n) for n, c in columns.items()], *tags, *extra)
    if whole:
        spans = rows.filter("_bound is not null").select("corpus", F.floor(F.col("cpos") / BLOCK).alias("_k"), "cpos", "_bound").groupBy("corpus", "_k").agg((F.min("cpos") - 1).alias("_lo"), (F.max("_bound") + 1).alias("_hi"))
        rows = point_in_interval(rows, "cpos", spans, "_lo", "_hi", width=BLOCK).withColumn("_block", F.col("_k")).withColumn("_own", F.floor(F.col("cpos") / BLOCK) == F.col("_k")).drop("_k", "_lo", "_hi")
    if engine == "sweep":
        work = _Sweep(plan, strategy)
    else:
        data = [*columns, *tags, *extra]
        work = _Simulation(plan, hoisted, constraint, {k: frozenset(v) for k, v in variables.items()}, strict, numbers, strategy, data)
    return result(rows.groupBy("corpus", "_block").applyInArrow(lambda table: work(table), MATCHES))


def _bit(s: object, corpus: Corpus, compiler: Compiler, variables: dict) -> Column:
    """What can be said of a symbol at a token without labels."""
    if isinstance(s, Tok):
        return compiler.test(_split(s.test, corpus)[0])
    if isinstance(s, Anchor):
        return F.lit(True)
    if s.name not in corpus.satts:
        raise BindError(f"unknown region {s.name}")
    test = F.coalesce(F.col("cpos") == F.col(f"{s.name}_{'end' if s.closing else 'start'}"), F.lit(False))
    if s.value is not None:
        value = F.col(f"{s.name}_value")
        valued = Compiler((f"{s.name}_value",), (), variables).test(Rel(s.op.lstrip("!"), Ref(f"{s.name}_value"), s.value))
        test = test & value.isNotNull() & (~valued if s.op.startswith("!") else valued)
    return test


def _leads(rows: DataFrame, query: Query, plan: Plan, paths: list[_Path], late: list, bits: list[Column], compiler: Compiler, strategy: str, strict: bool, numbers: tuple[int, int], edges: bool) -> DataFrame:
    """Each path as a conjunction over the tokens at its offsets; of those with one first symbol the shortest (or longest) that holds."""
    used: set[tuple[str, int]] = set()
    options: dict[int, list] = {}
    for path in paths:
        k, labels, open_, all_of, furthest, last = 0, {"match": 0}, {}, [], 0, path.size - 1
        for s in path.symbols:
            sym = plan.symbols[s]
            closing = isinstance(sym, Tag) and sym.closing
            at = k - 1 if closing else k
            furthest = max(furthest, at)
            used.add((f"t{s}", at))
            all_of.append(F.coalesce(F.col(_at(f"t{s}", at)), F.lit(False)))
            if not closing:  # a region that was entered isn't left but by its end tag
                for name, o in open_.items():
                    used.add((f"{name}_end", o))
                    all_of.append(F.col("cpos") + k <= F.col(_at(f"{name}_end", o)))
            if isinstance(sym, Tag):
                if closing and sym.name in open_:
                    o = open_.pop(sym.name)
                    used.add((f"{sym.name}_end", o))
                    all_of.append(F.col(_at(f"{sym.name}_end", o)) == F.col("cpos") + k - 1)
                elif not closing:
                    last = max(last, k)
                    if strict:
                        open_[sym.name] = k
                continue
            if late[s] is not None:
                test = AtOffsets(compiler, labels, k, used)
                all_of.append(test.test(late[s]))
            if sym.label:
                labels[sym.label] = k
            if sym.marker in numbers:
                labels["target" if sym.marker == numbers[0] else "keyword"] = k
            k += not sym.ahead
        if query.constraint is not None:
            all_of.append(AtOffsets(compiler, {**labels, "matchend": path.size - 1}, None, used).test(query.constraint))
        # first what decides whether the tokens are there: a test may fail on what isn't
        if furthest:
            used.add(("cpos", furthest))
            all_of.insert(0, F.coalesce(F.col(_at("cpos", furthest)) == F.col("cpos") + furthest, F.lit(False)))
        all_of.insert(0, F.coalesce(F.col("_bound") >= F.col("cpos") + last, F.lit(False)))
        hit = all_of[0]
        for c in all_of[1:]:
            hit = hit & c
        point = lambda c: F.col("cpos") + labels[c] if c in labels else F.lit(None).cast("long")  # noqa: E731, B023
        size = -path.size if strategy == "longest" else path.size
        options.setdefault(path.symbols[0], []).append((size, path.final, F.when(F.coalesce(hit, F.lit(False)), F.struct((F.col("cpos") + path.size - 1).alias("matchend"), point("target").alias("target"), point("keyword").alias("keyword")))))
    raw = sorted({c for c, _ in used} - {"cpos"} - {f"t{i}" for i in range(len(bits))})
    rows = rows.select("corpus", "cpos", "_block", "_own", "_bound", *bits, *raw)
    if edges or any(k for _, k in used):
        w = Window.partitionBy("corpus", "_block").orderBy("cpos")
        move = lambda c, k: F.col(c) if k == 0 else F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    else:
        move = lambda c, k: F.col(c)
    # every lead once, then plain columns
    moved = rows.select("corpus", "cpos", "_own", "_bound", *[move(c, k).alias(_at(c, k)) for c, k in sorted(used)])
    ends = [F.coalesce(*[o for _, _, o in sorted(options[s], key=lambda o: o[:2])]) for s in sorted(options)]
    return moved.filter("_own").select("corpus", F.col("cpos").alias("match"), F.explode(F.array_distinct(F.array_compact(F.array(*ends)))).alias("e")).select("corpus", "match", "e.*")


def _at(column: str, k: int) -> str:
    return f"{column}__{k}".replace("-", "m")


MATCHES = "corpus string, match bigint, matchend bigint, target bigint, keyword bigint"


def _table(corpus: str | None, found: list[np.ndarray] | list[list]) -> pa.Table:
    """Typed, also without a row."""
    cols = [pa.array(c, pa.int64()) for c in found]
    return pa.table([pa.array([corpus] * len(cols[0]), pa.string()), *cols], names=["corpus", "match", "matchend", "target", "keyword"])


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The block in order, its positions, the last position each start may reach (-1: none may start), and whether it is the block's own."""
    table = table.sort_by("cpos")
    cpos = table["cpos"].to_numpy()
    bound = table["_bound"].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
    return table, cpos, bound, table["_own"].to_numpy() & (bound >= cpos)


class _Sweep:
    """Advances all starts of a block together, a set of starts per state."""

    def __init__(self, plan: Plan, strategy: str) -> None:
        self.steps, self.final, self.longest = plan.steps, sorted(plan.final), strategy == "longest"
        self.ahead = [s.ahead for s in plan.symbols]

    def __call__(self, table: pa.Table) -> pa.Table:
        name = table["corpus"][0].as_py() if table.num_rows else None
        table, cpos, bound, may = _sorted(table)
        bits = [table[f"t{i}"].to_numpy() for i in range(len(self.ahead))]
        # positions are rows as far as they follow each other
        ends = np.append(np.flatnonzero(np.diff(cpos) != 1), len(cpos) - 1)
        run = ends[np.searchsorted(ends, np.arange(len(cpos)))] if len(cpos) else ends
        limit = np.minimum(run, np.arange(len(cpos)) + bound - cpos)
        out: list[np.ndarray] = []
        for first in sorted(self.steps[0]):
            begun = np.flatnonzero(may & bits[first])
            end = self._from(first, begun, bits, run, limit)
            hit = end >= 0
            out.append(np.stack([cpos[begun[hit]], cpos[end[hit]]]))
        both = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        none = [None] * both.shape[1]
        return _table(name, [both[0], both[1], none, none])

    def _from(self, first: int, begun: np.ndarray, bits: list[np.ndarray], run: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Row of the end of the match from each start, -1 without one."""
        end = np.full(len(begun), -1, np.int64)
        live = {0: np.arange(len(begun))}
        k = 0
        while live:
            todo = sorted(live)
            while todo:  # what looks ahead takes nothing
                q = todo.pop(0)
                for s, t in self.steps[q].items():
                    if not self.ahead[s] or (q == 0 and s != first):
                        continue
                    at = begun[live[q]] + k
                    ok = (at <= run[begun[live[q]]]) & (at <= limit[begun[live[q]]] + 1)
                    ok[ok] = bits[s][at[ok]]
                    before = live.get(t)
                    now = live[q][ok] if before is None else np.union1d(before, live[q][ok])
                    if len(now) and (before is None or len(now) > len(before)):
                        live[t] = now
                        if t not in todo:
                            todo.append(t)
            if k:
                for q in self.final:
                    if q in live:
                        end[live[q]] = begun[live[q]] + k - 1
            after: dict[int, list[np.ndarray]] = {}
            for q, who in live.items():
                if not self.longest:
                    who = who[end[who] < 0]
                at = begun[who] + k
                who, at = who[at <= limit[begun[who]]], at[at <= limit[begun[who]]]
                for s, t in self.steps[q].items():
                    if not self.ahead[s] and (q or s == first) and (got := who[bits[s][at]]).size:
                        after.setdefault(t, []).append(got)
            live = {t: x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for t, x in after.items()}
            k += 1
        return end


class _Simulation:
    """Runs the automaton from every own position of a block at which a first symbol holds."""

    def __init__(self, plan: Plan, late: list, constraint: object | None, variables: dict, strict: bool, numbers: tuple[int, int], strategy: str, columns: list[str]) -> None:
        self.plan, self.late, self.constraint, self.variables = plan, late, constraint, variables
        self.strict, self.numbers, self.strategy, self.columns = strict, numbers, strategy, columns

    def __call__(self, table: pa.Table) -> pa.Table:
        name = table["corpus"][0].as_py() if table.num_rows else None
        table, cpos, bound, may = _sorted(table)
        symbols, first = self.plan.symbols, sorted(self.plan.steps[0])
        bits = [table[f"t{i}"].to_numpy() for i in range(len(symbols))]
        at = {s: may if isinstance(symbols[s], (Tag, Anchor)) and symbols[s].closing else may & bits[s] for s in first}
        starts = np.flatnonzero(np.any(list(at.values()), axis=0)).tolist()
        if not starts:
            return _table(None, [[], [], [], []])
        self.cpos = cpos.tolist()
        self.where = {c: i for i, c in enumerate(self.cpos)}
        self.bits = [b.tolist() for b in bits]
        self.data = {c: table[c].to_pylist() for c in self.columns}
        self.eval = Evaluator(self.variables, self._get)
        out: list[tuple] = []
        for i in starts:
            seen = set()
            for s in first:
                if at[s][i] and (hit := self._from(i, s, int(bound[i]))) is not None and hit not in seen:
                    seen.add(hit)
                    out.append(hit)
        return _table(name, list(zip(*out, strict=True)) if out else [[], [], [], []])

    def _get(self, name: str, cpos: int):
        i = self.where.get(cpos)
        return None if i is None else self.data[name][i]

    def _zero(self, s, sym, cpos: int, start: int, labels: dict) -> dict | None:
        """The labels after a zero-width symbol between cpos - 1 and cpos, or None."""
        if isinstance(sym, Anchor):
            i = self.where[start]
            at = {"match": "_ps", "matchend": "_pe", "target": "_pt", "keyword": "_pk"}[sym.name]
            at = "_pe" if sym.name == "match" and sym.closing else at
            there = self.data[at][i]
            return labels if there is not None and there == (cpos - 1 if sym.closing else cpos) else None
        i = self.where.get(cpos - 1 if isinstance(sym, Tag) and sym.closing else cpos)
        if i is None or not self.bits[s][i]:
            return None
        if isinstance(sym, Tok):
            return self._bind(s, sym, cpos, labels)
        if not self.strict:
            return labels
        key = ("<", sym.name)
        if not sym.closing:
            return {**labels, key: self.data[f"{sym.name}_end"][i]}
        if key in labels:
            if labels[key] != cpos - 1:
                return None
            return {k: v for k, v in labels.items() if k != key}
        return labels

    def _bind(self, s, sym, cpos: int, labels: dict) -> dict | None:
        gone: set = set()
        if self.late[s] is not None and not self.eval.test(self.late[s], cpos, labels, gone):
            return None
        if sym.label or sym.marker is not None or gone:
            labels = {k: v for k, v in labels.items() if k not in gone}
            if sym.label:
                labels[sym.label] = cpos
            if sym.marker == self.numbers[0]:
                labels["target"] = cpos
            elif sym.marker == self.numbers[1]:
                labels["keyword"] = cpos
        return labels

    def _from(self, i: int, only: int, bound: int) -> tuple | None:
        start = self.cpos[i]
        steps, final, symbols = self.plan.steps, self.plan.final, self.plan.symbols
        states: dict[int, dict] = {0: {"match": start}}
        cpos, best = start, None
        while states:
            # zero-width symbols until nothing is new; at the boundary only tags, and look-ahead one beyond
            todo = sorted(states)
            while todo:
                q = todo.pop(0)
                for s, t in sorted(steps[q].items()):
                    sym = symbols[s]
                    if isinstance(sym, Tok) and not sym.ahead or (q == 0 and s != only):
                        continue
                    limit = cpos - 1 if not isinstance(sym, Tok) and sym.closing else cpos
                    if limit > bound + (isinstance(sym, Tok) and sym.ahead) or self._past(states[q], limit):
                        continue
                    after = self._zero(s, sym, cpos, start, states[q])
                    if after is not None and states.get(t) != after:
                        if t in states and t in todo:
                            todo.remove(t)
                        new = t not in states
                        states[t] = after
                        if new:
                            todo.append(t)
            if cpos > start:
                for q in sorted(states):
                    if q in final:
                        labels = {**states[q], "matchend": cpos - 1}
                        if self.constraint is None or self.eval.test(self.constraint, None, labels):
                            best = (start, cpos - 1, labels.get("target"), labels.get("keyword"))
                            if self.strategy != "longest":
                                return best
                            break
            j = self.where.get(cpos)
            if j is None or cpos > bound:
                break
            after = {}
            for q in sorted(states):
                for s, t in sorted(steps[q].items()):
                    sym = symbols[s]
                    if not isinstance(sym, Tok) or sym.ahead or not self.bits[s][j] or (q == 0 and s != only) or self._past(states[q], cpos):
                        continue
                    labels = self._bind(s, sym, cpos, states[q])
                    if labels is not None:
                        after[t] = labels  # the last write of a position holds
            states, cpos = after, cpos + 1
        return best

    def _past(self, labels: dict, cpos: int) -> bool:
        return self.strict and any(type(k) is tuple and cpos > v for k, v in labels.items())
