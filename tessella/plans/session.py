"""Query sessions: commands, named results, variables, macros, options."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.model import RESULT, Corpus, result
from tessella.operators import alignment, cooccur, display, frequency, intervals, refine, sequence
from tessella.operators.frequency import Span
from tessella.plans.language import ANCHORS, STRATEGIES, MUQuery, Parser, Query, QuerySyntaxError, Ref, Rel, Str, TABQuery, Tok, parse
from tessella.plans.macros import Macros, split_arguments
from tessella.sources import results, vertical

WRITTEN = ("cat", "tabulate", "dump", "group", "count", "size", "show", "info")


# Settings of the terminal, the pager, debugging or the file system, which are kept and change no result here.
INERT: dict[str, bool | int | str] = {
    "verbose_parser": False, "show_symtab": False, "show_gconstraints": False, "show_evaltree": False, "show_patlist": False, "show_dfa": False, "show_comp_dfa": False,
    "symtab_debug": False, "parser_debug": False, "tree_debug": False, "eval_debug": False, "initial_matchlist_debug": False, "debug_simulation": False, "search_debug": False,
    "server_log": True, "server_debug": False, "snoop": False, "parse_only": False, "silent": False, "child_process": False, "macro_debug": False, "cl_debug": False,
    "print_nr_matches": 0, "external_group": False, "external_group_command": "", "less_charset_variable": "LESSCHARSET", "readline": False, "default_corpus": "", "query_lock": 0,
    "macros": True, "user_level": 0, "local_corpus_directory": "", "registry": "", "data_directory": "", "history_file": "", "write_history": False, "paging": True, "pager": "less",
    "highlighting": True, "colour": False, "progress_bar": False, "auto_show": True, "timing": False, "optimize": False, "external_sort": False, "external_sort_command": "",
    "auto_save": False, "save_on_exit": False,
}
# Short names of options.
SHORT = {
    "eg": "externalgroup", "egc": "externalgroupcommand", "lcv": "lesscharsetvariable", "dc": "defaultcorpus", "hb": "hardboundary", "hc": "hardcut", "ql": "querylock", "m": "macros",
    "lcd": "localcorpusdirectory", "r": "registry", "dd": "datadirectory", "hf": "historyfile", "wh": "writehistory", "ms": "matchingstrategy", "sr": "strictregions", "p": "paging", "pg": "pager",
    "h": "highlighting", "col": "colour", "pb": "progressbar", "pp": "prettyprint", "c": "context", "lc": "leftcontext", "rc": "rightcontext", "ld": "leftkwicdelim", "rd": "rightkwicdelim",
    "pm": "printmode", "po": "printoptions", "ps": "printstructures", "sta": "showtagattributes", "st": "showtargets", "as": "autoshow", "o": "optimize", "ant": "anchornumbertarget",
    "ank": "anchornumberkeyword", "es": "externalsort", "esc": "externalsortcommand", "da": "defaultnonbrackattr", "sub": "autosubquery",
}
UNITS = {"character": "char", "char": "char", "chars": "char", "characters": "char", "word": "word", "words": "word"}


@dataclass
class Options:
    """Settings that change results or output, with their usual defaults; ``inert`` holds all others."""

    matching_strategy: str = "standard"
    strict_regions: bool = True
    hard_boundary: int = sequence.BOUNDARY
    hard_cut: int = 0
    default_nonbrack_attr: str = "word"
    anchor_number_target: int = 0
    anchor_number_keyword: int = 1
    auto_subquery: bool = False
    left_context: tuple[int, str] = (25, "char")
    right_context: tuple[int, str] = (25, "char")
    left_kwic_delim: str = "<"
    right_kwic_delim: str = ">"
    print_mode: str = "ascii"
    print_options: str = ""
    print_structures: str = ""
    show_tag_attributes: bool = True
    show_targets: bool = False
    pretty_print: bool = True
    inert: dict[str, bool | int | str] = field(default_factory=lambda: dict(INERT))

    def _find(self, name: str) -> str:
        key = name.lower().replace("_", "")
        key = SHORT.get(key, key)
        for n in [f.name for f in fields(self)] + list(self.inert):
            if n.replace("_", "") == key and n != "inert":
                return n
        if key == "context":
            return key
        raise QuerySyntaxError(f"unknown option {name}")

    def set(self, name: str, value: str) -> None:
        """Booleans take on/off and the like; contexts a number and a unit (characters, words or a region)."""
        n = self._find(name)
        if n in ("context", "left_context", "right_context"):
            m = re.fullmatch(r"(\d+)(?:\s+(\w+))?|(\w+)", value.strip())
            if not m:
                raise QuerySyntaxError(f"{name} takes a number and a unit")
            unit = m[2] or m[3] or "char"
            width = (int(m[1] or 1), UNITS.get(unit.lower(), unit))
            for side in ("left_context", "right_context"):
                if n in ("context", side):
                    setattr(self, side, width)
            return
        old = self.inert[n] if n in self.inert else getattr(self, n)
        if isinstance(old, bool):
            if value.lower() not in ("on", "yes", "1", "true", "off", "no", "0", "false"):
                raise QuerySyntaxError(f"{name} is on or off")
            new: bool | int | str = value.lower() in ("on", "yes", "1", "true")
        elif isinstance(old, int):
            if not re.fullmatch(r"-?\d+", value):
                raise QuerySyntaxError(f"{name} is a number")
            new = int(value)
        else:
            new = value
        if n == "matching_strategy" and new not in STRATEGIES:
            raise QuerySyntaxError(f"unknown strategy {new}")
        if n == "print_mode" and new not in display.MODES:
            raise QuerySyntaxError(f"unknown print mode {new}")
        if n in self.inert:
            self.inert[n] = new
        else:
            setattr(self, n, new)

    def show(self, name: str | None = None) -> dict[str, object]:
        every = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "inert"} | self.inert
        if name is None:
            return every
        n = self._find(name)
        return {n: every[n]} if n in every else {k: every[k] for k in ("left_context", "right_context")}


@dataclass
class Session:
    """``run(text)`` executes commands and gives the last one's value: a result, a table, text lines or None.

    Results stay lazy DataFrames; nothing is computed until they are read.
    """

    corpora: dict[str, Corpus]
    active: str | None = None
    results: dict[str, DataFrame] = field(default_factory=dict)
    mother: dict[str, str] = field(default_factory=dict)
    variables: dict[str, set[str]] = field(default_factory=dict)
    macros: Macros = field(default_factory=Macros)
    options: Options = field(default_factory=Options)
    seed: int = 42
    shown: dict[str, None] = field(default_factory=lambda: {"word": None})  # attributes, tags and aligned corpora that cat shows, in order
    show_cpos: bool = True
    queries: dict[str, str] = field(default_factory=dict)  # text of the query that made a result

    # -- helpers ------------------------------------------------------------
    def corpus(self, name: str | None = None) -> Corpus:
        name = name or self.active
        if name is None:
            raise QuerySyntaxError("no corpus is active")
        return self.corpora[self.mother.get(name, name)]

    def named(self, name: str) -> DataFrame:
        name = name.split(":")[-1]
        if "^" in name:
            base, satt = name.split("^")
            return refine.expand(self.corpus(base), self.named(base), 1, satt, both_needed=True)
        if name not in self.results:
            raise QuerySyntaxError(f"no result {name}")
        return self.results[name]

    def _keep(self, name: str, a: DataFrame, mother: str | None = None) -> DataFrame:
        a = result(a)
        mother = mother or self.mother.get(self.active, self.active)
        for n in {name, "Last"}:
            self.results[n], self.mother[n] = a, mother
        return a

    def query(self, text: str) -> DataFrame:
        return self._execute(parse(self.macros.expand(text), self.options.default_nonbrack_attr))

    def _test(self, text: str) -> object:
        return Parser(text, self.options.default_nonbrack_attr)._token().test

    def _execute(self, q: object) -> DataFrame:
        corpus = self.corpus()
        parents = self.results.get(self.active)
        if isinstance(q, MUQuery):
            found = cooccur.run_mu(corpus, q, self.variables)
        elif isinstance(q, TABQuery):
            found = cooccur.run_tab(corpus, q, self.variables)
        else:
            assert isinstance(q, Query)
            o = self.options
            found = sequence.run(corpus, q, self.variables, o.matching_strategy, parents, o.strict_regions, (o.anchor_number_target, o.anchor_number_keyword), self.corpora, o.hard_boundary)
            return self._hard_cut(found)
        if parents is not None:
            if q.__dict__.get("keep"):
                return self._hard_cut(intervals.containing(parents, found))
            from tessella.operators.ranges import point_in_interval
            p = intervals.non_overlapping(parents).select("corpus", F.col("match").alias("_s"), F.col("matchend").alias("_e"))
            found = result(point_in_interval(found, "match", p, "_s", "_e"))
        return self._hard_cut(found)

    def _hard_cut(self, found: DataFrame) -> DataFrame:
        """No more than the option HardCut allows, if it is set."""
        n = self.options.hard_cut
        return refine.first_rows(found, ["match", "matchend"], n) if n > 0 else found

    # -- commands -----------------------------------------------------------
    def run(self, text: str):
        out = None
        for command in self._commands(text):
            out = self.command(command)
        return out

    @staticmethod
    def _commands(text: str) -> list[str]:
        out, quote, cur = [], "", ""
        for c in text:
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            if c == ";" and not quote:
                if cur.strip():
                    out.append(cur.strip())
                cur = ""
            else:
                cur += c
        return [*out, cur.strip()] if cur.strip() else out

    def command(self, text: str):
        if m := re.fullmatch(r"/codist\s*[\[(](.*)[\])]", text.strip(), re.S):
            return self._codist(*split_arguments(m[1]))
        text = self.macros.expand(text)
        parts = self._commands(text)
        if len(parts) > 1:  # a macro may hold several commands; the last with a value gives it
            values = [v for v in map(self.command, parts) if v is not None]
            return values[-1] if values else None
        text = parts[0] if parts else ""
        if m := re.fullmatch(r"([A-Za-z_][\w-]*)\s*=\s*(.+)", text, re.S):
            return self._queried(m[1], m[2])
        word = re.match(r"\w*", text)[0]
        handler = getattr(self, f"_do_{word}", None)
        if handler:
            rest, at, append = self._redirected(text[len(word) :].strip()) if word in WRITTEN else (text[len(word) :].strip(), None, False)
            value = handler(rest)
            if at is None:
                return value
            self._write(value, at, append)
            return None
        if re.fullmatch(r"[A-Za-z_][\w-]*", text) and (text in self.corpora or text in self.results):
            self.active = text
            return None
        return self._queried("Last", text)

    def _queried(self, name: str, text: str) -> DataFrame:
        found = self._keep(name, self._value(text), self._mother_of(text))
        for n in {name, "Last"}:
            self.queries[n] = text
        if self.options.auto_subquery:
            self.active = name
        return found

    @staticmethod
    def _redirected(text: str) -> tuple[str, str | None, bool]:
        """The command without ``> "file"`` or ``>> "file"`` at its end; pipes to other programs are refused."""
        m = re.fullmatch(r"(.*?)\s*(>>?)\s*(?:\"([^\"]+)\"|'([^']+)')", text, re.S)
        if not m:
            return text, None, False
        at = m[3] or m[4]
        if at.lstrip().startswith("|"):
            raise QuerySyntaxError("output can't be piped to a program")
        return m[1], at, m[2] == ">>"

    def _write(self, value, at: str, append: bool) -> None:
        """As a folder of text files in order: lines as they are, tables with cells joined by TAB."""
        mode = "append" if append else "overwrite"
        if isinstance(value, (list, dict, int, str)):
            spark = next(iter(self.corpora.values())).tokens.sparkSession
            lines = value if isinstance(value, list) else [f"{k}\t{v}" for k, v in value.items()] if isinstance(value, dict) else [str(value)]
            spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode(mode).text(at)
            return
        order = [F.col(c) for c in ("corpus", "line_no", "line") if c in value.columns]
        shown = ["text"] if "line_no" in value.columns else [c for c in value.columns if c not in ("corpus", "line")]
        if set(RESULT) <= set(value.columns):
            order = [F.col("corpus"), F.coalesce("sort_rank", F.lit(0)), F.col("match"), F.desc("matchend")]
            shown = [c for c in value.columns if c not in RESULT]
        elif "first" in value.columns:
            order = [F.col("corpus"), F.col("first")]
        elif "freq" in value.columns:
            order = [F.col("corpus"), *([F.desc("source_freq")] if "source_freq" in value.columns else []), F.desc("freq"), F.col("source"), F.col("target")]
        rows = value.repartitionByRange(*order).sortWithinPartitions(*order)
        rows.select(display.text_lines(value, shown).alias("value")).write.mode(mode).text(at)

    def _codist(self, *args: str) -> DataFrame:
        """Values of an attribute around a word: ``/codist[att, "re", other]``, or of the default attribute without att."""
        if len(args) == 2:
            args = (self.options.default_nonbrack_attr, *args)
        if len(args) != 3:
            raise QuerySyntaxError("codist takes two or three arguments")
        att, pattern, other = args
        found = sequence.run(self.corpus(), Query(Tok(Rel("=", Ref(att), Str(pattern)))), self.variables)
        return frequency.grouped(self.corpus(), found, "match", other, ("match", att))

    def _mother_of(self, text: str) -> str | None:
        if m := re.match(r"from\s+(\S+)\s+to\s+(\S+)", text):
            return m[2]
        if m := re.match(r"(?:union|join|inter|intersection|diff|difference|subset)\s+(\S+)", text):
            return self.mother.get(m[1].split("^")[0])
        if re.fullmatch(r"[\w^:-]+", text) and text.split("^")[0] in self.mother:
            return self.mother[text.split("^")[0]]
        return None

    def _value(self, text: str) -> DataFrame:
        if m := re.fullmatch(r"(union|join|inter|intersection|diff|difference)\s+(\S+)\s+(\S+)", text):
            if self.mother.get(m[2].split("^")[0]) != self.mother.get(m[3].split("^")[0]):
                raise QuerySyntaxError("the results are of different corpora")
            op = {"union": intervals.union, "join": intervals.union, "inter": intervals.intersection, "intersection": intervals.intersection}.get(m[1], intervals.difference)
            return op(self.named(m[2]), self.named(m[3]))
        if m := re.fullmatch(r"subset\s+(\S+)\s+where\s+(\w+)\s*:\s*(.+)", text, re.S):
            return refine.subset(self.corpus(m[1]), self.named(m[1]), m[2], self._test(m[3]), self.variables)
        if m := re.fullmatch(r"from\s+(\S+)\s+to\s+(\S+)", text):
            return alignment.translate(self.named(m[1]), self.corpus(m[1]).beads.filter(F.col("target") == m[2]))
        if re.fullmatch(r"[\w^:-]+", text) and text.split("^")[0].split(":")[-1] in self.results:
            return self.named(text)
        found, _, rest = text.partition(" sort by ")
        a = self.query(found)
        return self._sorted(self.corpus(), a, rest) if rest else a

    def _do_set(self, text: str):
        if m := re.fullmatch(r"(\S+)\s+(match|matchend|target|keyword)\s+(.+)", text, re.S):
            if m[1] not in self.results:
                raise QuerySyntaxError(f"no result {m[1]}")
            a, to, how = self.named(m[1]), m[2], m[3].strip()
            if how == "NULL" or how in ANCHORS:
                out = refine.set_anchor(a, to, None if how == "NULL" else how)
            else:
                s = re.fullmatch(r"(leftmost|rightmost|nearest|farthest)\s+(.+?)\s+within\s+(?:(left|right)\s+)?(\d+\s+)?(\w+)(?:\s+from\s+(\w+))?(?:\s+(inclusive|exclusive))?", how, re.S)
                if not s:
                    raise QuerySyntaxError(f"can't read {how!r}")
                unit = None if s[5] in ("word", "words") else s[5]
                out = refine.set_anchor_search(self.corpus(m[1]), a, to, s[1], self._test(s[2]), int(s[4] or 1), unit, s[3] or "both", s[6] or "match", s[7] == "inclusive", self.variables)
            return self._keep(m[1], out, self.mother[m[1]])
        name, *value = text.split(None, 1)
        if not value:
            return self.options.show(name)
        self.options.set(name, value[0].strip().strip("\"'"))
        return None

    def _do_define(self, text: str):
        if m := re.fullmatch(r"macro\s+(\w+)\((.*?)\)\s*['\"](.*)['\"]", text, re.S):
            self.macros.define(m[1], int(m[2]) if m[2].strip().isdigit() else len(re.findall(r"\$\d", m[2])), m[3])
            return None
        if m := re.fullmatch(r"macro\s*<\s*[\"'](.+)[\"']", text):
            self.macros.read(Path(m[1]).read_text(), str(Path(m[1]).parent))
            return None
        m = re.fullmatch(r"\$(\w[\w-]*)\s*(\+=|-=|=|<)\s*(.+)", text, re.S)
        if not m:
            raise QuerySyntaxError(f"can't read define {text!r}")
        value = m[3].strip()
        if m[2] == "<":
            self.variables[m[1]] = self._items(value)
            return None
        items = self._items(value[1:].strip()) if value.startswith("<") else set(self.variables[value[1:]]) if value.startswith("$") else set(value.strip("\"'").split())
        old = self.variables.get(m[1], set())
        self.variables[m[1]] = items if m[2] == "=" else old | items if m[2] == "+=" else old - items
        return None

    @staticmethod
    def _items(path: str) -> set[str]:
        """A file's lines, each an item, blanks within it included."""
        return {x for x in Path(path.strip("\"'")).read_text().split("\n") if x}

    def _do_expand(self, text: str):
        m = re.fullmatch(r"(\S+)\s+(?:(left|right)\s+)?to\s+(\d+\s+)?(\w+)", text)
        return self._keep(m[1], refine.expand(self.corpus(m[1]), self.named(m[1]), int(m[3] or 1), None if m[4] in ("word", "words") else m[4], m[2] or "both"), self.mother[m[1]])

    def _do_cut(self, text: str):
        name, *n = text.split()
        return self._keep(name, refine.cut(self.named(name), *map(int, n)), self.mother[name])

    def _do_reduce(self, text: str):
        m = re.fullmatch(r"(\S+)\s+to\s+(?:(\d+)(%)?|maximal\s+matches)", text)
        a = self.named(m[1])
        out = refine.reduce_maximal(a) if m[2] is None else refine.reduce(a, percent=int(m[2]), seed=self.seed) if m[3] else refine.reduce(a, int(m[2]), seed=self.seed)
        return self._keep(m[1], out, self.mother[m[1]])

    def _do_delete(self, text: str):
        if m := re.fullmatch(r"(\S+)\s+(with|without)\s+(\w+)", text):
            out = refine.delete_by_anchor(self.named(m[1]), m[3], m[2] == "with")
        else:
            m = re.fullmatch(r"(\S+)\s+(\d+)(?:\s*\.\.\s*(\d+))?", text)
            out = refine.delete_lines(self.named(m[1]), int(m[2]), int(m[3]) if m[3] else None)
        return self._keep(m[1], out, self.mother[m[1]])

    def _do_discard(self, text: str):
        for n in text.split():
            self.results.pop(n, None)
            self.mother.pop(n, None)
        return None

    def _do_size(self, text: str):
        name, *rest = text.split()
        if name.startswith("$"):
            return len(self.variables[name[1:]])
        return refine.size(self.named(name), *rest)

    @staticmethod
    def _anchor(text: str) -> tuple[str, int]:
        m = re.fullmatch(r"(\w+)(?:\[(-?\d+)\])?", text.strip())
        if not m or m[1] not in ANCHORS:
            raise QuerySyntaxError(f"not an anchor: {text!r}")
        return m[1], int(m[2] or 0)

    def _span(self, text: str | None) -> Span:
        if not text:
            return Span()
        lo, _, hi = text.partition("..")
        a = self._anchor(lo)
        b = self._anchor(hi) if hi else a
        return Span(*a, *b)

    def _sorted(self, corpus: Corpus, a: DataFrame, rest: str) -> DataFrame:
        m = re.fullmatch(r"(\w+)(?:\s*%([cd]+))?(?:\s+on\s+(.+?))?(?:\s+(asc|ascending|desc|descending))?(?:\s+(reverse))?", rest.strip())
        if not m:
            raise QuerySyntaxError(f"can't read sort {rest!r}")
        return frequency.sort(corpus, a, m[1], "".join(sorted(m[2] or "")), self._span(m[3]), (m[4] or "").startswith("desc"), bool(m[5]))

    def _do_sort(self, text: str):
        name, _, rest = text.partition(" ")
        a, corpus = self.named(name), self.corpus(name)
        if not rest.strip():
            out = frequency.unsort(a)
        elif rest.strip().startswith("randomize"):
            out = frequency.randomize(a, int((rest.split() + ["0"])[1]) or self.seed)
        else:
            out = self._sorted(corpus, a, re.sub(r"^\s*by\s+", "", rest))
        return self._keep(name, out, self.mother[name])

    def _do_randomize(self, text: str):
        self.seed = int(text or 0)
        return None

    def _do_count(self, text: str):
        m = re.fullmatch(r"(\S+)\s+by\s+(\w+)(?:\s*%([cd]+))?(?:\s+on\s+(.+?))?(?:\s+(asc|ascending|desc|descending))?(?:\s+(reverse))?(?:\s+cut\s+(\d+))?", text)
        if not m:
            raise QuerySyntaxError(f"can't read count {text!r}")
        return frequency.count(self.corpus(m[1]), self.named(m[1]), m[2], "".join(sorted(m[3] or "")), self._span(m[4]), bool(m[6]), int(m[7] or 1), (m[5] or "").startswith("desc"))

    def _do_group(self, text: str):
        m = re.fullmatch(r"(\S+)\s+(\w+(?:\[-?\d+\])?)\s+(\w+)(?:\s+(by|foreach|group\s+by)\s+(\w+(?:\[-?\d+\])?)\s+(\w+))?(?:\s+cut\s+(\d+))?", text)
        a, corpus, cut = self.named(m[1]), self.corpus(m[1]), int(m[7] or 1)
        anchor, offset = self._anchor(m[2])
        if m[4] and m[4].startswith("group"):
            return frequency.grouped(corpus, a, anchor, m[3], (self._anchor(m[5])[0], m[6]), cut)
        by = (self._anchor(m[5])[0], m[6]) if m[4] else None
        return frequency.group(corpus, a, anchor, m[3], by, cut, offset, self._anchor(m[5])[1] if m[4] else 0)

    def _do_tabulate(self, text: str):
        m = re.fullmatch(r"(\S+)\s+(?:(\d+)\s+(\d+)\s+)?(.+)", text, re.S)
        a = self.named(m[1])
        if m[2]:
            a = refine.cut(a, int(m[2]), int(m[3]))
        items = []
        for part in m[4].split(","):
            g = re.fullmatch(r"\s*(\w+(?:\[-?\d+\])?(?:\s*\.\.\s*\w+(?:\[-?\d+\])?)?)(?:\s+(\w+))?(?:\s*%([cd]+))?\s*", part)
            if not g:
                raise QuerySyntaxError(f"can't read tabulate {part!r}")
            items.append(display.Item(self._span(g[1].replace(" ", "")), g[2], "".join(sorted(g[3] or ""))))
        return display.tabulate(self.corpus(m[1]), a, items)

    def _do_dump(self, text: str):
        name, *n = text.split()
        return display.dump(self.named(name), *map(int, n))

    def _view(self, corpus: Corpus) -> display.View:
        o = self.options
        (left, left_unit), (right, right_unit) = o.left_context, o.right_context
        atts = tuple(x for x in self.shown if x in corpus.patts)
        return display.View(
            left, right, left_unit, right_unit, atts or (corpus.patts[0],), tuple(x for x in self.shown if x in corpus.satts), o.show_tag_attributes, o.show_targets,
            tuple(x for x in re.split(r"[\s,]+", o.print_structures) if x in corpus.satts), (o.left_kwic_delim, o.right_kwic_delim), (o.anchor_number_target, o.anchor_number_keyword),
        )

    def _do_cat(self, text: str):
        """A concordance as rendered lines (corpus, line_no, text) in the print mode, or the text that is given."""
        if text.startswith(("\"", "'")):
            return [text[1:-1]]
        name, *n = text.split() if text else ["Last"]
        a, corpus, o = self.named(name), self.corpus(name), self.options
        if n:
            a = refine.cut(a, *[int(x) for x in n if x.isdigit()])
        wanted = {x for x in re.split(r"[\s,]+", o.print_options.lower()) if x}
        lines = display.rendered(display.concordance(corpus, a, self._view(corpus)), o.print_mode, self.show_cpos, bool(wanted & {"number", "num"}), bool(wanted & {"table", "tbl"}), (o.left_kwic_delim, o.right_kwic_delim))
        parts = [lines]
        for other in (x for x in self.shown if corpus.beads is not None and x in self.corpora and x not in corpus.patts + corpus.satts):
            # aligned text stands below its line
            beads = corpus.beads.filter(F.col("target") == other)
            texts = alignment.aligned_text(a, beads, self.corpora[other]).filter("aligned_text is not null")
            keyed = refine.line_numbers(a, "line_no").select("corpus", "line_no", "match", "matchend").join(texts, ["corpus", "match", "matchend"])
            parts.append(keyed.select("corpus", "line_no", F.concat(F.lit(f"-->{other}: "), "aligned_text").alias("text")))
        if wanted & {"header", "hdr"} or o.print_mode != "ascii":
            header = {"corpus": self.mother.get(name, name), "result": name, "query": self.queries.get(name, "")} if wanted & {"header", "hdr"} else None
            top, bottom = display.frame(o.print_mode, header, bool(wanted & {"table", "tbl"}), bool(wanted & {"border", "bdr"}))
            spark = lines.sparkSession
            parts += [spark.createDataFrame([("" if k < 0 else chr(0x10FFFF), k, x) for k, x in rows], "corpus string, line_no bigint, text string") for rows in ([(i - len(top), x) for i, x in enumerate(top)], list(enumerate(bottom))) if rows]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _do_show(self, text: str):
        words = text.split()
        if words and all(re.fullmatch(r"[+-]\w*", w) for w in words):
            for w in words:
                self._show_attribute(w[1:], w[0] == "+")
            return None
        if text == "cd":
            c = self.corpus()
            o = self.options
            return {
                "positional": {p: p in self.shown for p in c.patts}, "structural": {x: x in self.shown for x in c.satts},
                "aligned": {x: x in self.shown for x in self.corpora if c.beads is not None and x != self.active}, "left_context": o.left_context, "right_context": o.right_context,
                "cpos": self.show_cpos, "targets": o.show_targets,
            }
        if text in ("", "named"):
            return sorted(self.results)
        if text == "system" or text == "corpora":
            return sorted(self.corpora)
        if text == "active":
            return self.active
        if text == "options":
            return self.options.show()
        if text == "var":
            return {k: sorted(v) for k, v in self.variables.items()}
        if text.startswith("$"):
            return sorted(self.variables[text[1:]])
        if text.startswith("macro"):
            return sorted(f"{n}({k})" for n, k in self.macros.bodies)
        raise QuerySyntaxError(f"can't show {text!r}")

    def _show_attribute(self, name: str, on: bool) -> None:
        c = self.corpus()
        if name.lower() == "cpos" and "cpos" not in c.satts:
            self.show_cpos = on
        elif name.lower() == "targets" and "targets" not in c.satts:
            self.options.show_targets = on
        elif not name:
            self.shown = dict.fromkeys(c.patts) if on else {self.options.default_nonbrack_attr: None}
        elif name not in (*c.patts, *c.satts, *self.corpora):
            raise QuerySyntaxError(f"no attribute {name}")
        elif on:
            self.shown[name] = None
        else:
            self.shown.pop(name, None)

    def _do_save(self, text: str):
        """``save A`` or ``save A to "folder"``: the rows as Parquet."""
        m = re.fullmatch(r"(\S+)(?:\s+(?:to|>)\s*[\"'](.+)[\"'])?", text)
        at = m[2] or str(Path(str(self.options.inert["data_directory"] or "."), m[1]))
        results.save(self.named(m[1]), at)
        return at

    def _do_undump(self, text: str):
        """``undump A [with target [keyword]] [ascending] < "file"``: lines of two to four TAB columns; a first line that is one number is a count."""
        m = re.fullmatch(r"([A-Za-z_][\w-]*)((?:\s+with(?:\s+(?:target|keyword)){1,2})?)(\s+asc(?:ending)?)?\s*<\s*[\"'](.+)[\"']", text)
        if not m:
            raise QuerySyntaxError(f"can't read undump {text!r}")
        corpus, name = self.corpus(), self.mother.get(self.active, self.active)
        cells = F.split(F.trim("raw"), "\\s+")
        lines = vertical.read_files(corpus.tokens.sparkSession, m[4], name).filter(F.trim("raw") != "").filter((F.col("line_no") > 0) | (F.size(cells) > 1))
        anchors = re.findall(r"target|keyword", m[2])
        at = lambda k: F.get(cells, F.lit(k)).cast("long")
        rows = lines.select("corpus", F.col("line_no").alias("line"), at(0).alias("match"), at(1).alias("matchend"), *[at(2 + k).alias(x) for k, x in enumerate(anchors)])
        return self._keep(m[1], results.undump(corpus, rows, bool(m[3])), name)

    def _do_info(self, text: str):
        c = self.corpus(text or None)
        return {"p_attributes": list(c.patts), "s_attributes": list(c.satts), **c.properties}


def session(corpora: Mapping[str, Corpus], active: str | None = None) -> Session:
    return Session(dict(corpora), active or next(iter(corpora), None))


@dataclass
class Facade:
    """The query functions of the wire protocol, by the same names, over a session."""

    session: Session

    def query(self, mother: str, name: str, text: str) -> DataFrame:
        s = self.session
        s.active = mother
        return s._queried(name, text)

    def list_subcorpora(self, mother: str) -> list[str]:
        return sorted(n for n, m in self.session.mother.items() if m == mother and n in self.session.results)

    def subcorpus_size(self, name: str) -> DataFrame:
        return refine.size(self.session.named(name))

    def subcorpus_has_field(self, name: str, anchor: str) -> bool:
        return anchor in ("match", "matchend") or not self.session.named(name).filter(F.col(anchor).isNotNull()).isEmpty()

    def dump_subcorpus(self, name: str, anchor: str, first: int, last: int) -> DataFrame:
        """(corpus, line, <anchor>) of lines first to last."""
        return display.dump(self.session.named(name), first, last).select("corpus", "line", anchor)

    def drop_subcorpus(self, name: str) -> None:
        self.session._do_discard(name)

    def fdist_1(self, name: str, cutoff: int, anchor: str, att: str) -> DataFrame:
        """(corpus, value, freq) of at least ``cutoff``."""
        s = self.session
        return frequency.group(s.corpus(name), s.named(name), anchor, att, cut=cutoff).select("corpus", F.col("target").alias("value"), "freq")

    def fdist_2(self, name: str, cutoff: int, anchor1: str, att1: str, anchor2: str, att2: str) -> DataFrame:
        """(corpus, value1, value2, freq) of at least ``cutoff``."""
        s = self.session
        return frequency.group(s.corpus(name), s.named(name), anchor2, att2, (anchor1, att1), cutoff).select("corpus", F.col("source").alias("value1"), F.col("target").alias("value2"), "freq")
