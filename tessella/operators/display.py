"""Projection and display: tabulate, concordances, print modes, decoding."""

from __future__ import annotations

from dataclasses import dataclass
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.folding import fold
from tessella.model import Corpus, result
from tessella.operators.frequency import Span
from tessella.operators.ranges import point_in_interval
from tessella.operators.refine import line_numbers


@dataclass(frozen=True)
class Item:
    """One column of tabulate: an anchor or span, an attribute (None: the position), folding flags."""

    span: Span
    att: str | None = None
    flags: str = ""


def single(anchor: str, att: str | None = None, offset: int = 0, flags: str = "") -> Item:
    return Item(Span(anchor, offset, anchor, offset), att, flags)


def tabulate(corpus: Corpus, a: DataFrame, items: list[Item], names: list[str] | None = None) -> DataFrame:
    """(corpus, match, matchend, target, keyword, sort_rank, items...): one string per item; undefined positions are "-1", undefined values "".

    Positions beyond the corpus are undefined. Tokens of a span are joined by blanks; a span whose
    ends are inverted reads from right to left. Repeated rows of the result stay. The spans of all items meet the
    tokens in one join.
    """
    names = names or [f"item_{i}" for i in range(len(items))]
    rows = line_numbers(a, "_line")
    ends = [(F.col(i.span.lo) + i.span.lo_offset, F.col(i.span.hi) + i.span.hi_offset) for i in items]
    atts = list(dict.fromkeys(i.att for i in items if i.att is not None))
    if atts:
        # an item with an undefined end takes no tokens
        wanted = [F.struct(F.lit(k).alias("_i"), F.greatest(F.least(lo, hi), F.lit(0)).alias("_lo"), F.greatest(lo, hi).alias("_hi"), (lo + hi).alias("_ok")) for k, (i, (lo, hi)) in enumerate(zip(items, ends, strict=True)) if i.att is not None]
        spans = rows.select("corpus", "_line", F.inline(F.array(*wanted))).filter("_ok is not null").drop("_ok")
        value = {t: F.coalesce(f"{t}_value" if t in corpus.satts else t, F.lit("")) for t in atts}
        hit = point_in_interval(corpus.tokens.select("corpus", "cpos", *[v.alias(f"_v{k}") for k, v in enumerate(value.values())]), "cpos", spans, "_lo", "_hi")
        toks = hit.groupBy("corpus", "_line").agg(F.array_sort(F.collect_list(F.struct("_i", "cpos", *[f"_v{k}" for k in range(len(atts))]))).alias("_toks"))
        rows = rows.join(toks, ["corpus", "_line"], "left")
    if any(i.att is None for i in items):
        rows = rows.join(corpus.size(), "corpus", "left")
    out = []
    for k, (item, name, (lo, hi)) in enumerate(zip(items, names, ends, strict=True)):
        if item.att is None:
            one = lambda x: F.when((x >= 0) & (x < F.col("size")), x.cast("string")).otherwise(F.lit("-1"))
            same = (item.span.lo, item.span.lo_offset) == (item.span.hi, item.span.hi_offset)
            out.append((one(lo) if same else F.concat_ws(" ", one(lo), one(hi))).alias(name))
            continue
        v, flags = f"_v{atts.index(item.att)}", item.flags
        there = F.transform(F.filter("_toks", lambda x: x["_i"] == k), lambda x: x[v])  # noqa: B023
        there = F.when(lo > hi, F.reverse(there)).otherwise(there)
        there = F.transform(there, lambda x: fold(x, flags)) if flags else there  # noqa: B023
        out.append(F.coalesce(F.when((lo + hi).isNotNull(), F.array_join(there, " ")), F.lit("")).alias(name))
    return rows.select("corpus", "match", "matchend", "target", "keyword", "sort_rank", *out)


@dataclass(frozen=True)
class View:
    """What a concordance shows: the width of either context in ``char``, ``word`` or regions, attributes, tags, targets."""

    left: int = 25
    right: int = 25
    left_unit: str = "char"
    right_unit: str = "char"
    atts: tuple[str, ...] = ("word",)
    tags: tuple[str, ...] = ()
    tag_values: bool = True
    targets: bool = False
    structures: tuple[str, ...] = ()
    delimiters: tuple[str, str] = ("<", ">")
    numbers: tuple[int, int] = (0, 1)


def kwic(corpus: Corpus, a: DataFrame, left: int = 25, right: int = 25, unit: str = "char", att: str = "word", delimiters: tuple[str, str] = ("<", ">")) -> DataFrame:
    """``concordance`` with one unit and one attribute."""
    return concordance(corpus, a, View(left, right, unit, unit, (att,), delimiters=delimiters))


def concordance(corpus: Corpus, a: DataFrame, view: View = View()) -> DataFrame:  # noqa: B008
    """(corpus, line_no, match, matchend, target, keyword, sort_rank, structures, left_context, node, right_context, line).

    One row per row of the result, repeated ones included, numbered from 0 in sort order. Characters
    cut through tokens; a region context reaches to the edge of the n-th region on its side. Attributes
    of a token are joined by ``/``; tags stand before and after the tokens at their regions' edges; with ``targets``,
    the numbers of target and keyword follow their tokens in parentheses. structures holds ``<s value>`` of the
    regions at the match. Undefined values show as "".
    """
    rows = line_numbers(a, "line_no")
    for side, n, unit in (("left", view.left, view.left_unit), ("right", view.right, view.right_unit)):
        at, edge = ("match", "_l") if side == "left" else ("matchend", "_r")
        if unit in ("char", "word"):
            # a blank follows every token, even an empty one
            k = n if unit == "word" else n + 1
            rows = rows.withColumn(edge, F.greatest(F.col(at) - k, F.lit(0)) if side == "left" else F.col(at) + k)
        else:
            rows = rows.join(_edge(corpus, rows.select("corpus", at).distinct(), n, unit, side), ["corpus", at])
    cells = [F.coalesce(F.col(f"{t}_value" if t in corpus.satts else t), F.lit("")) for t in view.atts]
    cell = cells[0] if len(cells) == 1 else F.concat_ws("/", *cells)
    for s in view.tags:
        value = F.when(F.col(f"{s}_value").isNotNull(), F.concat(F.lit(" "), F.col(f"{s}_value"))).otherwise(F.lit("")) if view.tag_values else F.lit("")
        opened = F.when(F.col("cpos") == F.col(f"{s}_start"), F.concat(F.lit(f"<{s}"), value, F.lit(">"))).otherwise(F.lit(""))
        closed = F.when(F.col("cpos") == F.col(f"{s}_end"), F.lit(f"</{s}>")).otherwise(F.lit(""))
        cell = F.concat(F.coalesce(opened, F.lit("")), cell, F.coalesce(closed, F.lit("")))
    around = [F.when(F.col(f"{s}_id").isNotNull(), F.concat(F.lit(f"<{s} "), F.coalesce(f"{s}_value", F.lit("")), F.lit(">"))).alias(f"_s{k}") for k, s in enumerate(view.structures)]
    tokens = corpus.tokens.select("corpus", "cpos", cell.alias("_t"), *around)
    hit = point_in_interval(tokens, "cpos", rows.select("corpus", "line_no", "_l", "_r"), "_l", "_r")
    lines = rows.join(hit.groupBy("corpus", "line_no").agg(F.array_sort(F.collect_list(F.struct("cpos", "_t", *[f"_s{k}" for k in range(len(around))]))).alias("_toks")), ["corpus", "line_no"], "left")
    numbered = lambda x: F.concat(x["_t"], *[F.when(x["cpos"] == F.col(c), F.lit(f"({n})")).otherwise(F.lit("")) for c, n in zip(("target", "keyword"), view.numbers, strict=True)]) if view.targets else x["_t"]

    def part(test) -> Column:
        return F.coalesce(F.array_join(F.transform(F.filter("_toks", test), numbered), " "), F.lit(""))

    first = lambda k: F.get(F.filter("_toks", lambda x: x["cpos"] == F.col("match")), F.lit(0))[f"_s{k}"]
    lines = lines.withColumns({
        "structures": F.concat_ws(" ", *[first(k) for k in range(len(around))]) if around else F.lit(""),
        "left_context": part(lambda x: x["cpos"] < F.col("match")),
        "node": part(lambda x: (x["cpos"] >= F.col("match")) & (x["cpos"] <= F.col("matchend"))),
        "right_context": part(lambda x: x["cpos"] > F.col("matchend")),
    })
    if view.left_unit == "char":
        lines = lines.withColumn("left_context", F.right("left_context", F.lit(view.left)))
    if view.right_unit == "char":
        lines = lines.withColumn("right_context", F.left("right_context", F.lit(view.right)))
    line = F.concat(F.col("left_context"), F.lit(" " + view.delimiters[0]), F.col("node"), F.lit(view.delimiters[1] + " "), F.col("right_context"))
    return lines.select("corpus", "line_no", "match", "matchend", "target", "keyword", "sort_rank", "structures", "left_context", "node", "right_context", line.alias("line"))


def _edge(corpus: Corpus, key: DataFrame, n: int, satt: str, side: str) -> DataFrame:
    """(corpus, match or matchend, _l or _r): the far edge of the n-th region on that side of each position."""
    at, to, edge = ("match", "_l", "start") if side == "left" else ("matchend", "_r", "end")
    t = corpus.tokens.select("corpus", F.col("cpos").alias(at), F.col(f"{satt}_id").alias("_id"))
    regions = corpus.regions.filter(F.col("satt") == satt)
    ends = regions.groupBy("corpus").agg(F.min("struc").alias("_first"), F.max("struc").alias("_last"))
    rows = key.join(t, ["corpus", at], "left").join(ends, "corpus", "left")
    want = F.greatest(F.col("_id") - (n - 1), F.col("_first")) if side == "left" else F.least(F.col("_id") + (n - 1), F.col("_last"))
    rows = rows.withColumn("_want", F.when(F.col("_id").isNotNull(), want)).join(regions.select("corpus", F.col("struc").alias("_want"), F.col(edge).alias("_edge")), ["corpus", "_want"], "left")
    return rows.select("corpus", at, F.coalesce("_edge", at).alias(to))


MODES = ("ascii", "sgml", "html", "latex")


# What the print modes write for special characters.
TEX = {"&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}", "\\": "\\textbackslash{}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}


def _escaped(c: Column, mode: str) -> Column:
    if mode in ("html", "sgml"):
        return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    if mode == "latex":
        return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.create_map(*[F.lit(v) for kv in TEX.items() for v in kv])[x], x)), "")
    return c


def rendered(lines: DataFrame, mode: str = "ascii", cpos: bool = True, numbered: bool = False, table: bool = False, delimiters: tuple[str, str] = ("<", ">")) -> DataFrame:
    """(corpus, line_no, text): rows of ``concordance`` in a print mode, still distributed.

    ``cpos`` shows the position of the match, ``numbered`` the line's number, ``table`` writes table rows in html and latex.
    """
    if mode not in MODES:
        raise ValueError(f"unknown print mode {mode}")
    esc = lambda c: _escaped(F.col(c), mode)
    n = [F.concat((F.col("line_no") + 1).cast("string"), F.lit(". "))] if numbered else []
    s = F.when(F.col("structures") == "", F.lit("")).otherwise(F.concat(esc("structures"), F.lit(": ")))
    l, k, r = esc("left_context"), esc("node"), esc("right_context")
    p = F.col("match").cast("string")
    if mode == "ascii":
        text = F.concat(*n, *([F.lpad(p, 9, " "), F.lit(": ")] if cpos else []), s, l, F.lit(" " + delimiters[0]), k, F.lit(delimiters[1] + " "), r)
    elif mode == "html":
        cells = [*([F.concat(F.lit("<td>"), *n, F.lit("</td>"))] if n else []), *([F.concat(F.lit("<td>"), p, F.lit("</td>"))] if cpos else []), F.concat(F.lit("<td>"), s, F.lit("</td>"))]
        row = F.concat(F.lit("<tr>"), *cells, F.lit("<td align=right>"), l, F.lit("</td><td><b>"), k, F.lit("</b></td><td>"), r, F.lit("</td></tr>"))
        text = row if table else F.concat(F.lit("<li>"), *n, *([F.lit("<em>"), p, F.lit(":</em> ")] if cpos else []), s, l, F.lit(" <b>"), k, F.lit("</b> "), r)
    elif mode == "sgml":
        text = F.concat(F.lit("<LINE><MATCHNUM>"), p, F.lit("</MATCHNUM><STRUCS>"), esc("structures"), F.lit("</STRUCS><CONTENT>"), l, F.lit(" <MATCH>"), k, F.lit("</MATCH> "), r, F.lit("</CONTENT></LINE>"))
    else:
        sep = " & " if table else " "
        text = F.concat(F.lit("" if table else "\\item "), *n, *([p, F.lit(": ")] if cpos else []), s, l, F.lit(sep + "\\textbf{"), k, F.lit("}" + sep), r, F.lit(" \\\\" if table else ""))
    return lines.select("corpus", "line_no", text.alias("text"))


def frame(mode: str, header: dict[str, str] | None = None, table: bool = False, border: bool = False) -> tuple[list[str], list[str]]:
    """The lines before and after a rendered concordance; ``header`` names what is printed (corpus, query, size)."""
    if mode not in MODES:
        raise ValueError(f"unknown print mode {mode}")
    h = header or {}
    rule = "#" + "-" * 69
    if mode == "ascii":
        return ([rule, *[f"# {k}: {v}" for k, v in h.items()], rule] if h else []), []
    if mode == "html":
        top = [f"<em>{escape(k)}:</em> {escape(v)}<br>" for k, v in h.items()]
        return [*top, ("<table border=1>" if border else "<table>") if table else "<ul>"], ["</table>" if table else "</ul>"]
    if mode == "sgml":
        return ["<CONCORDANCE>", *[f"<{k.upper()}>{escape(v)}</{k.upper()}>" for k, v in h.items()]], ["</CONCORDANCE>"]
    kind = "tabular}{" + ("|r|c|l|" if border else "rcl") if table else "itemize"
    return [*[f"% {k}: {v}" for k, v in h.items()], f"\\begin{{{kind}}}"], ["\\end{tabular}" if table else "\\end{itemize}"]


def render(lines: list, mode: str = "ascii", numbered: bool = False, cpos: bool = True) -> list[str]:
    """Collected rows of ``concordance`` or ``kwic`` as text, for small results at hand; ``rendered`` does it distributed."""
    if mode not in MODES:
        raise ValueError(f"unknown print mode {mode}")
    out = []
    for i, r in enumerate(lines):
        n = f"{i + 1}. " if numbered else ""
        l, k, t = r["left_context"], r["node"], r["right_context"]
        if mode == "ascii":
            out.append(n + (f"{r['match']:>9}: " if cpos else "") + f"{l} <{k}> {t}")
        elif mode == "html":
            out.append(f"<tr><td align=right>{escape(l)}</td><td><b>{escape(k)}</b></td><td>{escape(t)}</td></tr>")
        elif mode == "sgml":
            out.append(f'<LINE><MATCHNUM>{r["match"]}</MATCHNUM><CONTENT>{escape(l)} <MATCH>{escape(k)}</MATCH> {escape(t)}</CONTENT></LINE>')
        else:
            tex = lambda s: "".join(TEX.get(c, c) for c in s)
            out.append(f"{n}{tex(l)} & \\textbf{{{tex(k)}}} & {tex(t)} \\\\")
    return out


def text_lines(rows: DataFrame, columns: list[str]) -> Column:
    """Cells joined by TAB; null is empty."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def dump(a: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(corpus, line, match, matchend, target, keyword) in sort order, -1 for undefined; rows first to last if given."""
    rows = line_numbers(a)
    if first is not None:
        rows = rows.filter((F.col("line") >= first) & (F.col("line") <= (last if last is not None else first)))
    anchor = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    return rows.select("corpus", "line", "match", "matchend", anchor("target"), anchor("keyword"))


def describe(corpus: Corpus) -> DataFrame:
    """(corpus, kind, name, tokens, types): sizes of every attribute."""
    out = None
    for p in corpus.patts:
        d = corpus.tokens.groupBy("corpus").agg(F.count("*").alias("tokens"), F.count_distinct(p).alias("types")).select("corpus", F.lit("p").alias("kind"), F.lit(p).alias("name"), "tokens", "types")
        out = d if out is None else out.unionByName(d)
    s = corpus.regions.groupBy("corpus", "satt").agg(F.count("*").alias("tokens"), F.count_distinct("value").alias("types")).select("corpus", F.lit("s").alias("kind"), F.col("satt").alias("name"), "tokens", "types")
    return s if out is None else out.unionByName(s)


def decode(corpus: Corpus, patts: list[str], start: int | None = None, end: int | None = None, satts: list[str] | None = None, mode: str = "lines", a: DataFrame | None = None) -> DataFrame:
    """(corpus, cpos, ord, line): the corpus as vertical text.

    mode ``lines`` has attributes by tabs, ``xml`` escapes them in ``<token>``
    elements, ``lisp`` writes parentheses; in all of them tags of ``satts`` stand on lines of their own,
    opened before (ord < 0) and closed after (ord > 0) their tokens. ``a``
    restricts to its ranges, which may not overlap.
    """
    tokens = corpus.tokens
    if start is not None:
        tokens = tokens.filter(F.col("cpos") >= start)
    if end is not None:
        tokens = tokens.filter(F.col("cpos") <= end)
    if a is not None:
        tokens = point_in_interval(tokens, "cpos", a.select("corpus", F.col("match").alias("_lo"), F.col("matchend").alias("_hi")), "_lo", "_hi").drop("_lo", "_hi")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.coalesce(F.col(p), F.lit("__UNDEF__")) for p in patts]
    if mode == "lines":
        line = F.concat_ws("\t", *cells)
    elif mode == "xml":
        line = F.concat(F.lit("<token>"), *[F.concat(F.lit(f'<attr name="{p}">'), esc(c), F.lit("</attr>")) for p, c in zip(patts, cells, strict=True)], F.lit("</token>"))
    elif mode == "lisp":
        line = F.concat(F.lit("("), *[F.concat(F.lit('"'), c, F.lit('" ' if i < len(cells) - 1 else '"')) for i, c in enumerate(cells)], F.lit(")"))
    else:
        raise ValueError(f"unknown mode {mode}")
    out = tokens.select("corpus", "cpos", F.lit(0).alias("ord"), line.alias("line"))
    for i, s in enumerate(satts or []):
        value = F.when(F.col(f"{s}_value").isNotNull(), F.concat(F.lit(" "), F.col(f"{s}_value"))).otherwise(F.lit(""))
        opened = tokens.filter(F.col("cpos") == F.col(f"{s}_start")).select("corpus", "cpos", F.lit(i - len(satts)).alias("ord"), F.concat(F.lit(f"<{s}"), value, F.lit(">")).alias("line"))
        closed = tokens.filter(F.col("cpos") == F.col(f"{s}_end")).select("corpus", "cpos", F.lit(len(satts) - i).alias("ord"), F.lit(f"</{s}>").alias("line"))
        out = out.unionByName(opened).unionByName(closed)
    return out


def render_groups(rows: list, mode: str = "ascii") -> list[str]:
    """Collected rows of a grouping (source, target, freq) as text; a repeated source shows once in ``ascii``."""
    if mode not in MODES:
        raise ValueError(f"unknown print mode {mode}")
    out, before = [], None
    for r in rows:
        s, t, n = r["source"], r["target"], r["freq"]
        if mode == "ascii":
            out.append(f"{'' if s == before else s:<28}  {t:<28}\t{n}")
        elif mode == "html":
            out.append(f"<tr><td>{escape(s)}</td><td>{escape(t)}</td><td align=right>{n}</td></tr>")
        elif mode == "sgml":
            out.append(f"<GROUP><SOURCE>{escape(s)}</SOURCE><TARGET>{escape(t)}</TARGET><FREQ>{n}</FREQ></GROUP>")
        else:
            tex = lambda x: "".join(TEX.get(c, c) for c in x)
            out.append(f"{tex(s)} & {tex(t)} & {n} \\\\")
        before = s
    return out


def decode_horizontal(corpus: Corpus, patts: list[str], satt: str) -> DataFrame:
    """(corpus, struc, line): one line per region, its tokens' attributes joined by ``/`` and the tokens by blanks."""
    cell = F.concat_ws("/", *[F.coalesce(F.col(p), F.lit("__UNDEF__")) for p in patts])
    rows = corpus.tokens.filter(F.col(f"{satt}_id").isNotNull()).select("corpus", F.col(f"{satt}_id").alias("struc"), F.struct("cpos", cell.alias("t")).alias("x"))
    return rows.groupBy("corpus", "struc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("line"))


def class_columns(tokens: DataFrame, mapping: DataFrame, att: str, out: str = "class") -> DataFrame:
    """Tokens with the class of a mapping (class, token) of one attribute; a token of several classes takes the least, others null."""
    classes = mapping.groupBy(F.col("token").alias(att)).agg(F.min("class").alias(out))
    return tokens.join(classes, att, "left")
