"""Passages of held-out items in documents: generalised suffix automata over words.

Words are compared by 64 bits of their hash; a passage is a run of such words, so that
all of them would have to collide.

1. Items are read into words and cut into blocks of bounded size (``item_parts``).
2. One pass reads all documents into words, whatever the number of blocks. A bit
   filter over the items' runs of ``least`` words, of bounded size, leaves the
   stretches that may hold a passage (``_stretches``); only these are written.
3. Stretches are led to the blocks by their runs of words, and each block's automaton, built in
   a task of its own, tracks the longest match along its stretches. What the filter let pass by chance finds none.
4. The places found are put together by text and item, so block borders don't show.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.filters import bit_filter, passes
from tessella.operators.skew import weighted_join
from tessella.session import cut

# Tags that end a line or a block; all others leave no gap between letters.
BREAKING = "br|p|div|li|ul|ol|dl|dt|dd|td|th|tr|table|caption|tbody|thead|hr|h[1-6]|pre|blockquote|ref|references|gallery|poem|center|section"

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BREAK = re.compile(rf"</?(?:{BREAKING})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_LINK = re.compile(r"\[\[[^\[\]\n|]*(?:\|[^\[\]\n|]*)*\|")
_URL = re.compile(r"\[(?:https?|ftp)?:?//[^\s\]]*")
_ROW = re.compile(r"^[ \t:]*(?:\{\||\|-)[^\n]*", re.M)
_JOIN = re.compile("'{2,}|\\[\\[|\\]\\]|[­​-‍⁠﻿]")
_WORD = re.compile("[^\\W_](?:[\0̀-ͯ]*[^\\W_]|[̀-ͯ])*")
GAP, NONE = " ", "\0"


def mask(text: str) -> str:
    """The text as a reader sees it, of the same length: what isn't seen becomes NONE where it
    leaves no gap between letters, else GAP; a character reference becomes its character and NONE."""
    t = text
    if "\0" in t:
        t = t.replace("\0", GAP)
    none = lambda m: NONE * len(m.group())
    gap = lambda m: GAP * len(m.group())
    if "<" in t:
        t = _COMMENT.sub(none, t)
        t = _BREAK.sub(gap, t)
        t = _TAG.sub(none, t)
    if "&" in t:
        t = _ENTITY.sub(_reference, t)
    if "{|" in t or "|-" in t:
        t = _ROW.sub(gap, t)
    if "[" in t:
        t = _URL.sub(gap, t)
        t = _LINK.sub(none, t)
    return _JOIN.sub(none, t)


def _reference(m: re.Match) -> str:
    raw = m.group()
    c = html.unescape(raw)
    if c == raw:
        return raw
    if c in "­​‌‍⁠﻿":
        c = NONE
    return (c + NONE * len(raw))[: len(raw)]


def fold(word: str) -> str:
    if NONE in word:
        word = word.replace(NONE, "")
    if word.isascii():
        return word.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", word).casefold())


def words(text: str) -> list[str]:
    return [fold(w) for w in _WORD.findall(mask(text))]


class Automaton:
    """Generalised suffix automaton of some items' words.

    ``step[v]`` maps a word to the next state, ``link`` and ``size`` are
    the suffix links and longest lengths. ``level[v]`` is the state on v's link
    path that holds its suffix of ``least`` words (-1 if v is shorter), and
    ``items[level]`` the items that hold those words.
    """

    def __init__(self, items: list[tuple[int, list]], least: int) -> None:
        self.least = least
        step: list[dict] = [{}]
        link, size = [-1], [0]
        for _, code in items:
            last = 0
            for c in code:
                last = self._extend(step, link, size, last, c)
        self.step, self.link, self.size = step, link, size
        self.level = [-1] * len(size)
        for v in sorted(range(1, len(size)), key=size.__getitem__):
            if size[v] >= least:
                self.level[v] = v if size[link[v]] < least else self.level[link[v]]
        found: dict[int, set[int]] = {}
        for i, code in items:
            v = 0
            for n, c in enumerate(code, 1):
                v = step[v][c]
                if n >= least:
                    found.setdefault(self.level[v], set()).add(i)
        self.items = {k: tuple(sorted(x)) for k, x in found.items()}

    @staticmethod
    def _extend(step: list[dict], link: list[int], size: list[int], last: int, c: object) -> int:
        def split(p: int, q: int) -> int:
            """State for what p reads by c, cut out of q where q also holds longer strings."""
            if size[p] + 1 == size[q]:
                return q
            step.append(dict(step[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            new = len(size) - 1
            link[q] = new
            while p != -1 and step[p].get(c) == q:
                step[p][c] = new
                p = link[p]
            return new

        if c in step[last]:  # another item began alike
            return split(last, step[last][c])
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        new, p = len(size) - 1, last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            link[new] = split(p, step[p][c])
        return new

    def ends(self, code: list) -> list[tuple[int, int]]:
        """(position, level state) of every word that ends a match of ``least`` words or more."""
        out: list[tuple[int, int]] = []
        step, link, size, level, least = self.step, self.link, self.size, self.level, self.least
        v = n = 0
        for at, c in enumerate(code):
            while v and c not in step[v]:
                v = link[v]
                n = size[v]
            if c in step[v]:
                v = step[v][c]
                n += 1
            if n >= least:
                # n may fall short of the state's own strings, never of its level's
                out.append((at, level[v]))
        return out

    def runs(self, code: list) -> dict[int, list[list[int]]]:
        """By item, the first and last place of each run of places where a match ends."""
        out: dict[int, list[list[int]]] = {}
        for at, level in self.ends(code):
            for i in self.items[level]:
                runs = out.setdefault(i, [])
                if runs and runs[-1][1] == at - 1:
                    runs[-1][1] = at
                else:
                    runs.append([at, at])
        return out


class _Codes(dict):
    """Written form of a word to 64 bits of the folded word's hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = xxhash.xxh3_64_intdigest(fold(word).encode("utf-8", "surrogatepass"))
        code -= (code >> 63) << 64
        self[word] = code
        return code


def _coded(text: str, codes: _Codes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, _WORD.findall(mask(text))), np.int64)


def _grams(code: np.ndarray, least: int) -> np.ndarray:
    """A hash of each run of ``least`` words, mixed so that any of its bits serve as bit numbers."""
    words_ = code.view(np.uint64)
    n = len(words_) - least + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(least if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words_[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


PARTS = "item_id bigint, part int, item_words int, n bigint, codes array<bigint>"


def item_parts(items: DataFrame, least: int, block_words: int) -> tuple[DataFrame, int, int]:
    """(item_id, item_words, codes, n, block): the items' words in parts of at most ``block_words``, hashed into blocks of about as many; words and blocks in all.

    Parts of one item share ``least`` - 1 words, so every run of ``least`` words lies in one of them.
    Items shorter than ``least`` words, or without id or text, have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        stride = max(block_words - least + 1, 1)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code = _coded(text, codes)
                for k, s in enumerate(range(0, len(code) - least + 1, stride)):
                    part = code[s : s + stride + least - 1]
                    rows.append((i, k, len(code), len(part), part))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item_id", "part", "item_words", "n", "codes"])

    parts = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(run, PARTS)
    parts = cut(parts.dropDuplicates(["item_id", "codes"]), "item-parts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    return parts.withColumn("block", F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)).cast("long")), total, blocks


STRETCHES = "doc_id bigint, t1 bigint, t2 bigint, k int, start int, doc_words int, codes array<bigint>"


def _stretches(documents: DataFrame, bits: bytes, least: int) -> DataFrame:
    """(doc_id, t1, t2, k, start, doc_words, codes): of each document row, the stretches of words whose runs all pass the filter.

    t1 and t2, 128 bits of hash, stand for the text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, table = _Codes(), np.frombuffer(shared.value, np.uint8)
        for b in batches:
            rows = []
            for doc, t1, t2, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                code = _coded(text, codes)
                if len(code) < least:
                    continue
                hit = passes(_grams(code, least), table)
                if hit.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
                    for k, (a, z) in enumerate(zip(edges[::2], edges[1::2], strict=True)):
                        rows.append((doc, t1, t2, k, a, len(code), code[a : z + least - 1]))
            if rows:
                kinds = (*[pa.int64()] * 3, *[pa.int32()] * 3, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "t1", "t2", "k", "start", "doc_words", "codes"])

    return documents.select(F.col("doc_id").cast("long"), *_fingerprint(), "text").mapInArrow(run, STRETCHES)


def _fingerprint() -> list:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def _gram_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each list of words with its runs' hashes, once each, in the last column's place."""
        for b in batches:
            grams = [np.unique(_grams(np.array(c, np.int64), least)).view(np.int64) for c in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(grams, pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "grams"])

    return run


FOUND = "doc_id bigint, t1 bigint, t2 bigint, copies bigint, item_id bigint, doc_words int, first int, last int"
ROW = ["doc_id", "t1", "t2"]
SHARE = 100_000


def _walk(parts: pa.Table, stretches: pa.Table, least: int) -> pa.Table:
    """The stretches led to a block, along the automaton of its items."""
    rows: list[tuple] = []
    if parts.num_rows and stretches.num_rows:
        auto = Automaton(list(zip(parts["item_id"].to_pylist(), parts["codes"].to_pylist(), strict=True)), least)
        for doc, t1, t2, copies, start, n, code in zip(*(stretches[c].to_pylist() for c in (*ROW, "copies", "start", "doc_words", "codes")), strict=True):
            for i, runs in auto.runs(code).items():
                rows += [(doc, t1, t2, copies, i, n, start + a, start + z) for a, z in runs]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    kinds = (*[pa.int64()] * 5, *[pa.int32()] * 3)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*ROW, "copies", "item_id", "doc_words", "first", "last"])


def _leaked(documents: DataFrame, items: DataFrame, least: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """The items' parts, and by document, text and item the runs of places where a match ends; equal rows of documents come once, with their number."""
    parts, runs, blocks = item_parts(items, least, block_words)
    grams = parts.select("block", "codes").mapInArrow(_gram_rows(least), "block bigint, grams array<bigint>").select("block", F.explode("grams").alias("gram"))
    stretches = cut(_stretches(documents.filter("text is not null"), bit_filter(grams, runs), least), "stretches")
    once = stretches.groupBy(*ROW, "k").agg(*[F.first(c).alias(c) for c in ("start", "doc_words", "codes")], F.count("*").alias("copies"))
    led = once.withColumn("block", F.lit(0).cast("long"))
    if blocks > 1:
        # lead stretches to the blocks that share a run with them; runs found in many stretches are salted
        own = once.select(*ROW, "k", "codes").mapInArrow(_gram_rows(least), "doc_id bigint, t1 bigint, t2 bigint, k int, grams array<bigint>").select(*ROW, "k", F.explode("grams").alias("gram"))
        known = grams.distinct().join(own.groupBy("gram").agg(F.count("*").alias("w")), "gram")
        to = weighted_join(own, known, ["gram"], "w", ["doc_id", "t1", "k"]).select(*ROW, "k", "block").distinct()
        led = cut(once.join(to, [*ROW, "k"]), "led-stretches")
    # a block that many stretches lead to is walked by several tasks, each with its automaton
    shares = led.groupBy("block").agg(F.ceil(F.sum(F.size("codes")) / SHARE).cast("int").alias("tasks"))
    left = parts.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).select("block", "share", "item_id", "codes")
    right = led.join(shares, "block").withColumn("share", F.pmod(F.xxhash64(*ROW, "k"), F.col("tasks")).cast("int")).select("block", "share", *ROW, "copies", "start", "doc_words", "codes")
    return parts, left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(lambda a, b: _walk(a, b, least), FOUND)


LEAKS = "doc_id bigint, copies bigint, item_id bigint, doc_words int, longest int, matched int"


def _joined(runs: list[tuple[int, int]], least: int) -> list[list[int]]:
    """Words covered by runs of places where matches of ``least`` words end; runs that follow each other are one."""
    out: list[list[int]] = []
    end = None
    for a, z in sorted(runs):
        if end is not None and a <= end + 1:
            out[-1][1] = end = max(end, z)
        else:
            out.append([a - least + 1, z])
            end = z
    return out


def _covered(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def find_leaks(documents: DataFrame, items: DataFrame, least: int = 8, block_words: int = 200_000) -> DataFrame:
    """(doc_id, item_id, longest, matched, item_words, doc_words): documents that hold ``least`` consecutive words of an item.

    longest is the longest stretch all of whose runs of ``least`` words are the item's, matched the
    document's words in any such stretch. Words are what ``words`` reads. ``block_words`` bounds an
    automaton and changes no result; neither the number of items nor the length of one is limited.

    Null or empty texts, a null doc_id or item_id, and items shorter than ``least`` words
    give no rows; repeated documents each count, and of a repeated item_id all texts
    together are the item (item_words is the longest one's). Other columns aren't looked at.

    Jobs run when this is called: items are blocked and made a filter, documents read once. What is left, the
    stretches with candidates, is a table.
    """
    parts, found = _leaked(documents.filter("doc_id is not null"), items, least, block_words)
    lists = found.groupBy(*ROW, "item_id").agg(F.first("copies").alias("copies"), F.first("doc_words").alias("doc_words"), F.collect_set(F.struct("first", "last")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for runs in b.column(4).to_pylist():
                spans = _joined([(r["first"], r["last"]) for r in runs], least)
                out.append((max(z - a + 1 for a, z in spans), sum(z - a + 1 for a, z in _covered(spans))))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *[pa.array([x[k] for x in out], pa.int32()) for k in (0, 1)]], names=["doc_id", "copies", "item_id", "doc_words", "longest", "matched"])

    each = lists.select("doc_id", "copies", "item_id", "doc_words", "runs").mapInArrow(run, LEAKS)
    sizes = parts.groupBy("item_id").agg(F.max("item_words").alias("item_words"))
    # equal rows of documents are rows of their own
    return each.join(sizes, "item_id").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "item_id", "longest", "matched", "item_words", "doc_words")


CLEANED = "doc_id bigint, text string, removed_words int, doc_words int, dropped boolean"


def remove_leaks(documents: DataFrame, items: DataFrame, least: int = 8, remove_from: int = 13, max_coverage: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """(doc_id, text, removed_words, doc_words, dropped): documents without what leaked.

    Matched stretches of ``remove_from`` words or more are cut out of the raw
    text, from the first to the last letter. Where stretches of ``least`` words or
    more cover over ``max_coverage`` of a document's words, it is dropped: its
    text is null. All documents come out once per row; null texts stay null
    and are not dropped. ``block_words`` changes no result (see ``find_leaks``, and for the jobs run when this is called).

    Texts with leaks are told by their hash; a bit filter of bounded size sends all other rows
    past the join that brings the stretches to cut.
    """
    # only the text matters, so equal texts count as equal rows
    _, found = _leaked(documents.withColumn("doc_id", F.lit(0)), items, least, block_words)
    leaks = cut(found.groupBy("t1", "t2").agg(F.collect_set(F.struct("item_id", "first", "last")).alias("runs"), F.first("copies").alias("w")), "leaks")
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(leaks.select(F.col("t1").alias("gram")), leaks.count()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            t1 = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(passes(t1, table))], names=[*b.schema.names, "may"])

    keyed = documents.select(F.col("doc_id").cast("long"), "text", *_fingerprint())
    flagged = keyed.mapInArrow(marked, "doc_id bigint, text string, t1 bigint, t2 bigint, may boolean")
    runs = weighted_join(flagged.filter("may"), leaks, ["t1", "t2"], "w", ["doc_id"], how="left").select("doc_id", "text", "runs")
    all_rows = flagged.filter("not may").select("doc_id", "text", F.lit(None).cast(leaks.schema["runs"].dataType).alias("runs")).unionByName(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, runs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if text is None:
                    out.append((doc, None, 0, 0, False))
                    continue
                if not runs:
                    out.append((doc, text, 0, len(_WORD.findall(mask(text))), False))
                    continue
                at = [m.span() for m in _WORD.finditer(mask(text))]
                by_item: dict[int, list] = {}
                for r in runs:
                    by_item.setdefault(r["item_id"], []).append((r["first"], r["last"]))
                covered = _covered([x for v in by_item.values() for x in _joined(v, least)])
                if sum(z - a + 1 for a, z in covered) > max_coverage * len(at):
                    out.append((doc, None, len(at), len(at), True))
                    continue
                gone = [x for x in covered if x[1] - x[0] + 1 >= remove_from]
                for a, z in reversed(gone):
                    text = text[: at[a][0]] + text[at[z][1] :]
                out.append((doc, text, sum(z - a + 1 for a, z in gone), len(at), False))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "text", "removed_words", "doc_words", "dropped"])

    return all_rows.mapInArrow(run, CLEANED)
