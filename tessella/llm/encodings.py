"""Text decoded with the wrong character encoding: learned from clean near-twins, found and restored."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.filters import bit_filter, may_hold
from tessella.operators.skew import weighted_join
from tessella.session import cut, partitions

# The encodings a text may have been written in, and wrongly read in.
WRITTEN = ("cp1252", "cp1251", "cp1253", "koi8-r", "cp866", "iso8859-5", "iso8859-7", "mac_roman", "cp1250")
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "koi8-r", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15")

SEGMENT = re.compile(r"\n|(?<=[.!?]) ")
WORD = re.compile("[0-9A-Za-z]*[^\0-\x7f][0-9A-Za-z\x80-\U0010ffff]*")
RUN = re.compile("[^\0-\x7f]+")
HIDDEN = re.compile("[^!-~]")
LOST = re.compile("[\\s\x7f-\xa0\xad]")
UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
OWN_RUNS, OWN_WORDS = "learned>runs", "learned>words"
STRIPPED = "—–“”„‘’‚…•"
MARK = "�"
C1 = re.compile("[\x80-\x84\x86-\x9f]")
META = {chr(b): bytes([b]).decode("cp1252") for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _table(codec: str) -> str:
    """The upper half of a one-byte encoding; bytes it doesn't define stand for themselves."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _defined(codec: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return out


def _rules() -> dict[str, tuple[str, str]]:
    """name: (written, read) of every transformation that can be told from twins."""
    out = {f"utf-8>{d}": ("utf-8", d) for d in READ}
    for e in WRITTEN:
        for d in READ:
            # pairs that agree on nearly all letters aren't worth a rule
            if sum(a != b for a, b in zip(_table(e)[64:], _table(d)[64:], strict=True)) > 8:
                out[f"{e}>{d}"] = (e, d)
    return out


class Rules:
    """Transformations by name, applied forwards (to check twins) and backwards (to restore).

    ``units`` are the mappings learned from twins, by rule: garbled characters to the clean one. Those of
    the rule "" are of a transformation that no pair of encodings explains.
    """

    def __init__(self, names: list[str] | None = None, units: dict[str, dict[str, str]] | None = None) -> None:
        self.units = units or {}
        own = self.units.get("", {})
        self.own_single = {g: c for g, c in own.items() if len(g) == 1}
        several = sorted((g for g in own if len(g) > 1), key=len, reverse=True)
        self.own_multi = re.compile(f"(?:{'|'.join(map(re.escape, several))})+") if several else None
        self.own_unit = re.compile("|".join(map(re.escape, several))) if several else None
        every = _rules()
        self.names = [n for n in every if names is None or n in names or every[n][0] == "utf-8"]
        # taught rules first: they win ties
        self.multi = sorted((n for n in self.names if every[n][0] == "utf-8"), key=lambda n: names is not None and n not in names)
        self.single = [n for n in self.names if every[n][0] != "utf-8"]
        # characters outside the table are no bytes; C1 controls stand for bytes it doesn't define
        self.read = {n: str.maketrans({chr(b): "\u0100" for b in range(160, 256)} | {c: chr(b) for b, c in enumerate(_table(every[n][1]), 128)}) for n in self.multi}
        self.write = {n: str.maketrans({chr(b): c for b, c in enumerate(_table(every[n][1]), 128)}) for n in self.multi}
        self.there, self.back = {}, {}
        for n in self.single:
            e, d = every[n]
            t = _table(d)
            self.there[n] = {c: t[b - 128] for c, b in _defined(e).items()}
            self.back[n] = {g: c for c, g in self.there[n].items()}

    def forwards(self, n: str, clean: str) -> str | None:
        if n in self.write:
            return clean.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.write[n])
        there = self.there[n]
        if any(c not in there for c in clean):
            return None
        return "".join(map(there.__getitem__, clean))

    def between(self, garbled: str, clean: str) -> set[str]:
        """Rules that turn the one into the other, whatever invisible characters were lost since."""
        if not garbled or not clean:
            return set()
        if set(garbled) == {MARK}:
            return {"cp1252>utf-8"}
        seen = LOST.sub("", garbled)
        out = set()
        for n in self.names:
            once = self.forwards(n, clean)
            if once is None or once == clean:
                continue
            if LOST.sub("", once) == seen or (n in self.write and LOST.sub("", self.forwards(n, once) or "") == seen):
                out.add(n)
        return out

    def undo_multi(self, run: str, alphabet: frozenset[str]) -> tuple[str, str] | None:
        """(restored run, rule) if UTF-8 sequences in it, read by a rule, give usual characters and leave few letters over."""
        best = None
        torn = bool(C1.search(run))  # garbled in any case, so controls may come of it
        word = run.isalpha() and len({_script(c) for c in run}) == 1
        for n in self.multi:
            as_bytes = run.translate(self.read[n])
            found = 0
            parts, at, leads = [], 0, set()
            for m in UTF8.finditer(as_bytes):
                c = m.group().encode("latin-1").decode("utf-8", "replace")
                if c in alphabet or (torn and c <= "\x9f"):
                    parts += [run[at : m.start()], c]
                    at = m.end()
                    found += at - m.start()
                    leads.add(run[m.start()])
            if found:
                rest = "".join(parts[::2]) + run[at:]
                # first bytes whose others were stripped don't count as left over
                left = sum(c.isalpha() and c not in leads for c in rest)
                restored = "".join(parts) + run[at:]
                if word and (any(map(str.isalpha, rest)) or len({_script(c) for c in restored if c.isalpha()}) > 1):
                    continue  # it is a word as it stands
                if left < found and (best is None or (found, -left) > best[0]):
                    best = ((found, -left), restored, n)
        return best and (best[1], best[2])

    def remains(self, run: str, names: set[str], alphabet: frozenset[str]) -> bool:
        """A run of UTF-8 sequences that give letters of European scripts, as none is left but where ``undo_multi`` had to stop."""
        for n in names & self.read.keys():
            hits = list(UTF8.finditer(run.translate(self.read[n])))
            # lines of boxes hold such sequences by chance; their first characters are no letters
            covered = sum(m.end() - m.start() for m in hits) == len(run)
            for m in hits:
                c = m.group().encode("latin-1").decode("utf-8", "replace")
                if (covered or run[m.start()].isalpha()) and ("\u00c0" <= c <= "\u017f" or "\u0386" <= c <= "\u045f" or c in alphabet):
                    return True
        return False

    def leftover(self, run: str, restored: str, n: str) -> set[str]:
        """First bytes' characters that ``undo_multi`` left in the run, as the others were stripped."""
        leads = {run[m.start()] for m in UTF8.finditer(run.translate(self.read[n]))}
        rest = Counter(restored)
        rest.subtract(m.group().encode("latin-1").decode("utf-8", "replace") for m in UTF8.finditer(run.translate(self.read[n])))
        return {c for c in leads if rest[c] > 0}

    def undo_own(self, run: str, alphabet: frozenset[str]) -> tuple[str, str] | None:
        """(restored run, OWN_RUNS) if learned sequences of several characters make up the whole run, and give a word."""
        if self.own_multi is None or not self.own_multi.fullmatch(run):
            return None
        clean = self.own_unit.sub(lambda m: self.units[""][m.group()], run)
        return (clean, OWN_RUNS) if _wordlike(clean) and set(clean) <= alphabet else None

    def origin(self, rule: str, garbled: str, clean: str) -> str:
        """``learned`` if twins showed every mapping that turns the one into the other, ``codec`` if the rule's encodings supplied some."""
        units = self.units.get(rule, {})
        if rule in (OWN_RUNS, OWN_WORDS):
            return "learned"
        if rule in self.write:
            there = {g: c for g, c in ((self.forwards(rule, c), c) for c in set(clean) if c > "\x7f") if g in garbled}
            return "learned" if there and all(units.get(g) == c for g, c in there.items()) else "codec"
        pairs = {(g, c) for g, c in zip(garbled, clean) if g > "\x7f" and g != c}  # noqa: B905
        return "learned" if len(garbled) == len(clean) and pairs and all(units.get(g) == c for g, c in pairs) else "codec"

    def undo_single(self, word: str, alphabet: frozenset[str]) -> list[tuple[str, str]]:
        """(restored word, rule) for each rule whose inverse gives usual characters that make a word."""
        high = {c for c in word if c > "\x7f"}
        out = []
        if high and high <= self.own_single.keys():
            u = "".join(self.own_single.get(c, c) for c in word)
            if all(c in alphabet for c in u if c > "\x7f") and _wordlike(u):
                out.append((u, OWN_WORDS))
        for n in self.single:
            back = self.back[n]
            if high <= back.keys():
                u = "".join(back.get(c, c) if c > "\x7f" else c for c in word)
                if u != word and all(c in alphabet for c in u if c > "\x7f") and _wordlike(u):
                    out.append((u, n))
        return out


def _letters(word: str) -> str:
    return re.sub(r"\A[\W_]+|[\W_]+\Z", "", word)


def _script(c: str) -> str:
    return "latin" if c < "Ͱ" else "greek" if c < "Ѐ" else "cyrillic" if c < "԰" else "other"


def _wordlike(word: str) -> bool:
    """Letters of one script (or digits) but for the edges; or a single symbol."""
    core = _letters(word)
    if not core:
        return True
    core = core.replace("’", "").replace("·", "")
    letters = [c for c in core if c.isalpha()]
    return core.isalnum() and not any(unicodedata.category(c) in ("Lm", "No") and c > "\x7f" for c in core) and len({_script(c) for c in letters}) <= 1


def plain(text: str) -> str:
    """The text with its character references resolved, as a later step may have written garbled characters so."""
    return html.unescape(text) if "&" in text else text


def _key(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


TERMS = "kind string, key bigint, text string, n bigint"
LEAST_SKELETON = 12


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every document: its characters, its words with non-ASCII characters, and segments with their skeleton; counted ahead."""
    chars: Counter = Counter()
    vocab: Counter = Counter()
    segments: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [("c", 0, k, n) for k, n in chars.items()] + [("w", 0, k, n) for k, n in vocab.items()] + [("s", k, t, n) for (k, t), n in segments.items()]
        for c in (chars, vocab, segments):
            c.clear()
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["kind", "key", "text", "n"])

    for b in batches:
        for raw in b.column(0).to_pylist():
            chars[""] += 1
            if raw.isascii() and "&" not in raw:
                continue
            text = plain(raw)
            chars.update({c for c in set(text) if c > "\x7f"})
            vocab.update(set(WORD.findall(text)))
            for s in {s for s in SEGMENT.split(text) if not s.isascii()}:
                skeleton = HIDDEN.sub("", s)
                if len(skeleton) >= LEAST_SKELETON:
                    segments[_key(skeleton), s] += 1
        if len(vocab) > 200_000 or len(segments) > 30_000:
            yield flush()
    if chars:
        yield flush()


TWINS = "kind string, rule string, garbled string, clean string"


def _units(pairs: list[tuple[str, str]]) -> dict[str, str] | None:
    """Garbled characters to the clean one, if one mapping of as many characters each explains all pairs of a segment.

    For transformations that no encodings explain the bar is high: at least three different runs and
    four different clean characters, one mapping both ways, and no character that stays.
    """
    if len(set(pairs)) < 3:
        return None
    for m in (1, 2, 3):
        if all(len(g) == m * len(c) for g, c in pairs):
            both = {(g[m * k : m * k + m], x) for g, c in pairs for k, x in enumerate(c)}
            units = dict(both)
            if len(units) == len(both) == len(set(units.values())) >= 4 and all(x not in g for g, x in both):
                return units
    return None


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Between equal ASCII characters lie runs of others. Where a segment's differ from its twin's by one transformation, out come:

    ``run``: the rule of encodings that explains it, and each pair of runs; ``unit``: each mapping of garbled
    characters to a clean one in these. Without such a rule, units come out under the rule "" if all runs
    differ and ``_units`` finds one mapping; the twin in more documents, or the shorter one, is then taken as clean.
    """
    rules = Rules()
    memo: dict[tuple[str, str], set[str]] = {}

    def between(a: str, b: str) -> set[str]:
        if (a, b) not in memo:
            if len(memo) > 100_000:
                memo.clear()
            memo[a, b] = rules.between(a, b)
        return memo[a, b]

    def units_of(name: str, a: str, b: str) -> list[tuple[str, str]]:
        if name in rules.write:
            every = [(rules.forwards(name, c), c) for c in b]
            return [x for x in every if x[0] != x[1]] if "".join(g for g, _ in every) == a else []
        return [(g, c) for g, c in zip(a, b, strict=True) if g != c] if len(a) == len(b) else []

    split = re.compile("[!-~]")
    for batch in batches:
        rows = []
        for one, two, rarer in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            every = [(x.replace(" ", ""), y.replace(" ", "")) for x, y in zip(split.split(one), split.split(two), strict=True)]
            pairs = [(a, b) for a, b in every if a != b]
            if not pairs:
                continue
            for side in (pairs, [(b, a) for a, b in pairs]):
                common: set[str] | None = None
                for a, b in side:
                    common = between(a, b) if common is None else common & between(a, b)
                    if not common:
                        break
                if common:
                    name = min(common, key=lambda n: rules.names.index(n) if n in rules.names else -1)
                    rows += [("run", name, a, b) for a, b in side]
                    rows += [("unit", name, g, c) for a, b in side for g, c in units_of(name, a, b)]
                    break
            else:
                words = [(x.split(), y.split()) for x, y in zip(split.split(one), split.split(two), strict=True)]
                if all(len(x) == len(y) for x, y in words):
                    pairs = [p for x, y in words for p in zip(x, y, strict=True)]
                    for side, sure in ((pairs, rarer), ([(b, a) for a, b in pairs], not rarer)):
                        units = _units(side)
                        if units and (sure or len(next(iter(units))) > 1):
                            rows += [("unit", "", g, c) for g, c in units.items()]
                            break
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["kind", "rule", "garbled", "clean"])


def learn(terms: DataFrame) -> DataFrame:
    """(kind, rule, garbled, clean, n): mappings by character alignment of segments with equal skeletons (see ``_align``).

    The skeleton is the segment without non-ASCII characters (and blanks),
    LEAST_SKELETON characters at least. Each variant of a skeleton is aligned
    with the one in most documents, so pairs are no more than variants.
    """
    segments = terms.filter("kind = 's'")
    best = segments.groupBy("key").agg(F.max_by(F.struct("text", "n"), F.struct("n", -F.length("text"), "text")).alias("twin"), F.count("*").alias("v")).filter("v > 1")
    # a skeleton may have very many variants
    pairs = weighted_join(segments, best, ["key"], "v", ["text"]).filter(F.col("text") != F.col("twin.text")).select("text", F.col("twin.text").alias("twin"), (F.col("n") < F.col("twin.n")).alias("rarer"))
    return pairs.mapInArrow(_align, TWINS).groupBy("kind", "rule", "garbled", "clean").agg(F.count("*").alias("n"))


def learned_units(learned: DataFrame, min_support: int, agreement: float = 0.9) -> dict[str, dict[str, str]]:
    """By rule, the mappings that hold: seen ``min_support`` times, and in a share ``agreement`` of what their garbled characters were aligned with.

    Under a rule a code point has one garbled form, so there are at most as many as rules times code points in use.
    """
    units = learned.filter("kind = 'unit'")
    total = units.groupBy("rule", "garbled").agg(F.sum("n").alias("all"))
    held = units.join(total, ["rule", "garbled"]).filter((F.col("n") >= min_support) & (F.col("n") >= agreement * F.col("all")))
    out: dict[str, dict[str, str]] = {}
    for r in held.select("rule", "garbled", "clean").collect():
        out.setdefault(r.rule, {})[r.garbled] = r.clean
    return out


CANDIDATES = "word string, n bigint, clean string, rule string, origin string, wordlike boolean"


def _candidates(rule_names: list[str], units: dict[str, dict[str, str]], alphabet: frozenset[str]) -> Callable:
    """What the words of the collection, each once, may have been under the one-byte rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(rule_names, units)
        for b in batches:
            rows: list[tuple] = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = rules.undo_single(w, alphabet)
                if "â" in w:
                    found += [(w.replace("â", c), "stripped") for c in STRIPPED if c in alphabet]
                if found:
                    like = _wordlike(w)
                    rows += [(w, n, u, rule, "mark" if rule == "stripped" else rules.origin(rule, w, u), like) for u, rule in found]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word", "n", "clean", "rule", "origin", "wordlike"])

    return run


HITS = "doc_id bigint, kind string, word string, clean string, rule string, origin string"


def _hits(rule_names: list[str], units: dict[str, dict[str, str]], alphabet: frozenset[str], shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(rule_names, units)
        bits = shared.value
        runs: dict[str, tuple[str, str, str, str, str] | None] = {}
        words: dict[str, bool] = {}

        def listed(w: str) -> bool:
            return may_hold(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42), bits)  # Spark's own hash

        def undone(r: str) -> tuple[str, str, str, str, str] | None:
            found = (rules.undo_multi(r, alphabet) or rules.undo_own(r, alphabet)) if len(r) > 1 else None
            # by learned mappings alone, a run that is a word as it stands needs company
            kind = "maybe" if found and found[1] == OWN_RUNS and _wordlike(r) else "run"
            return found and (kind, r, *found, rules.origin(found[1], r, found[0]))

        for b in batches:
            rows: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if raw.isascii() and "&" not in raw:
                    continue
                text = plain(raw)
                if MARK in text:
                    rows.append((doc, "mark", MARK, "", "cp1252>utf-8", "mark"))
                for c in set(C1.findall(text)):
                    rows.append((doc, "mark", c, META.get(c, ""), "cp1252>latin-1", "mark"))
                for r in set(RUN.findall(text)):
                    if r not in runs:
                        if len(runs) > 200_000:
                            runs.clear()
                        runs[r] = undone(r)
                    if hit := runs[r]:
                        rows.append((doc, *hit))
                for w in set(WORD.findall(text)):
                    if w not in words:
                        if len(words) > 400_000:
                            words.clear()
                        words[w] = listed(w)
                    if words[w]:
                        rows.append((doc, "word", w, "", "", ""))
            if rows:
                kinds = (pa.int64(), *[pa.string()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "kind", "word", "clean", "rule", "origin"])

    return run


def _alphabet(terms: DataFrame, share: float) -> frozenset[str]:
    """Characters in a share of the documents (3 at least). No more than there are code points."""
    counted = {r.text: r.n for r in terms.filter("kind = 'c'").select("text", "n").collect()}
    least = max(3, share * counted.get("", 0))
    return frozenset(c for c, n in counted.items() if c > "\x9f" and n >= least)


def _judge(terms: DataFrame, names: list[str], units: dict[str, dict[str, str]], alphabet: frozenset[str]) -> DataFrame:
    """(word, clean, rule, origin, strong, weak, n): words that the collection's own words show to be garbled."""
    words = terms.filter("kind = 'w'").select(F.col("text").alias("word"), "n")
    vocab = words.groupBy(F.lower("word").alias("form")).agg(F.sum("n").alias("m"))
    cand = words.repartition(partitions(terms.sparkSession), "word").mapInArrow(_candidates(names, units, alphabet), CANDIDATES)
    known = (
        cand.withColumn("form", F.lower("clean")).join(vocab.withColumnRenamed("m", "n_clean"), "form").drop("form")
        .withColumn("form", F.lower("word")).join(vocab.withColumnRenamed("m", "n_word"), "form").drop("form")
    )
    size = F.length("clean")
    loose = ~F.col("wordlike")
    odd = (loose & (F.col("n_clean") >= 3 * F.col("n_word"))) | (~loose & (size >= 4) & (F.col("n_clean") >= 8 * F.col("n_word")))
    lone = (F.col("rule") == "stripped") & (F.col("n_clean") >= 20 * F.col("n_word"))
    # a letter by itself in place of a common symbol
    symbol = (size == 1) & ~F.col("clean").rlike("(?U)\\w") & (F.col("n_clean") >= 100 * F.col("n_word"))
    strong = F.when(F.col("rule") == "stripped", lone).otherwise(odd | symbol)
    weak = (F.col("n_clean") >= 2) & (F.col("n_clean") > F.col("n_word")) & (size >= 3) & (F.col("rule") != "stripped")
    return known.select("word", "clean", "rule", "origin", strong.alias("strong"), weak.alias("weak"), "n").filter("strong or weak")


def _words_found(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, word, clean, rule, origin, strong): the judged words in the documents; heavy words are salted."""
    one = judged.groupBy("word").agg(F.collect_list(F.struct("clean", "rule", "origin", "strong")).alias("as"), F.max("n").alias("w"))  # no more than there are rules
    return weighted_join(hits.filter("kind = 'word'").select("doc_id", "word"), one, ["word"], "w", ["doc_id"]).select("doc_id", "word", F.explode("as").alias("a")).select("doc_id", "word", "a.*")


def find_garbled(documents: DataFrame, min_support: int = 2, usual: float = 0.0005, untaught: int = 5) -> DataFrame:
    """(doc_id, word, clean, rule, origin): every garbled word or run of a document, with what it was.

    1. Segments whose text without non-ASCII characters is equal are near-twins;
       their runs of other characters are aligned, and the differences become mappings
       of garbled characters to clean ones (``learn``, ``learned_units``), by the encodings that explain them, or by none.
    2. Mappings of rules with ``min_support`` pairs of runs are applied to every
       document. A run of UTF-8 sequences under a rule is garbled if it
       gives characters of the collection's alphabet (in a share ``usual`` of all documents) and
       leaves fewer letters over. A word under a one-byte rule is garbled if the
       collection holds the restored word clearly more often; if both are
       words, more is asked, or two such words by one rule in the document.
       origin is ``learned`` where twins showed every mapping it took, and ``codec`` where the
       rule's encodings filled in characters that no twin showed.
       A UTF-8 rule without that support needs ``untaught`` runs in a document.
    3. U+FFFD, C1 controls, and a lone first byte's character whose others were stripped,
       show garbled text that can't be restored (clean is "" or a guess); their origin is ``mark``.

    Null texts or ids give no rows; ASCII texts neither. Each row of
    documents counts by itself, repeated ids together. All counts cover all documents.
    What a word may have been is worked out once per distinct word; documents are
    then searched for the judged words by a broadcast bit filter of bounded size and an exact join.
    Jobs run when this is called: terms are counted, mappings learned, words judged and documents searched, each once.
    """
    docs = documents.filter("text is not null and doc_id is not null")
    terms = cut(docs.select("text").mapInArrow(_terms, TERMS).groupBy("kind", "key", "text").agg(F.sum("n").alias("n")), "terms")
    learned = cut(learn(terms), "learned")
    taught = learned.filter("kind = 'run'").groupBy("rule").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_support)
    names = sorted(r.rule for r in taught.collect())  # at most as many as there are rules
    units = learned_units(learned, min_support)
    alphabet = _alphabet(terms, usual)
    judged = cut(_judge(terms, names, units, alphabet), "judged-words")
    words = judged.select("word").distinct()
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(words.select(F.xxhash64("word").alias("gram")), words.count()))
    hits = cut(docs.select("doc_id", "text").mapInArrow(_hits(names, units, alphabet, shared), HITS), "hits")
    runs = hits.filter("kind = 'run'")
    known = F.col("rule").isin(*names, OWN_RUNS)
    # a rule that no twin taught must show itself in several runs of the document
    told = runs.filter(~known).groupBy("doc_id", "rule").agg(F.count_distinct("word").alias("k")).filter(F.col("k") >= untaught).select("doc_id", "rule")
    out = ["doc_id", "word", "clean", "rule", "origin"]
    sure = hits.filter((F.col("kind") == "mark") | ((F.col("kind") == "run") & known)).unionByName(runs.join(told, ["doc_id", "rule"]).select(hits.columns)).select(*out)
    company = runs.filter(F.col("rule") == OWN_RUNS).select("doc_id").distinct()
    sure = sure.unionByName(hits.filter("kind = 'maybe'").join(company, "doc_id").select(*out))
    found = cut(_words_found(hits, judged), "words")
    enough = found.groupBy("doc_id", "rule").agg(F.max("strong").alias("s"), F.count_distinct("word").alias("k")).filter("s or k >= 2").select("doc_id", "rule")
    return sure.unionByName(found.join(enough, ["doc_id", "rule"]).select(*out))


def garbled_documents(documents: DataFrame, **options) -> DataFrame:
    """(doc_id) of the documents with at least one garbled passage."""
    return find_garbled(documents, **options).select("doc_id").distinct()


RESTORED = "doc_id bigint, restored string, whole boolean"


def _controls(run: str, marks: dict[str, str], multi: bool) -> str:
    """The run with its C1 controls as they were written, but for those that belong to what is left of a UTF-8 sequence."""

    def put(m: re.Match) -> str:
        kept = UTF8.match(m.group()) or m.group()[:2] == "â\x80" or (multi and "Â" <= m.group()[0] <= "ô")
        return m.group() if kept else m.group().translate(table)

    table = str.maketrans(marks)
    return re.sub("[\xc2-\xf4][\x80-\xbf]+|[\x80-\x9f]+", put, run)


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every document: its non-ASCII characters, as ``_terms`` counts them; counted ahead."""
    chars: Counter = Counter()
    for b in batches:
        for raw in b.column(0).to_pylist():
            chars[""] += 1
            if not raw.isascii() or "&" in raw:
                chars.update(c for c in set(plain(raw)) if c > "\x7f")
    if chars:
        n = len(chars)
        yield pa.RecordBatch.from_arrays([pa.array(["c"] * n), pa.array([0] * n, pa.int64()), pa.array(chars.keys(), pa.string()), pa.array(chars.values(), pa.int64())], names=["kind", "key", "text", "n"])


def restore(documents: DataFrame, found: DataFrame, usual: float = 0.0005) -> DataFrame:
    """(doc_id, restored, whole): garbled documents with every mapping of ``found`` applied to their text, as often as was garbled.

    What a mapping gives is undone again until nothing changes, with the collection's
    alphabet (``usual`` as in ``find_garbled``). whole is false where characters
    remain that can't be had back, a C1 control among them, or a run that is garbled still. A document's
    mappings are no more than its own words.
    """
    counted = documents.filter("text is not null and doc_id is not null").select("text").mapInArrow(_characters, TERMS)
    alphabet = _alphabet(counted.groupBy("kind", "key", "text").agg(F.sum("n").alias("n")), usual) | frozenset(_LATIN)
    maps = found.filter("clean <> ''").groupBy("doc_id").agg(F.collect_set(F.struct("word", "clean", "rule")).alias("maps"))
    every = found.select("doc_id").distinct().join(maps, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[str, ...], Rules] = {}

        def rules_for(names: set[str]) -> Rules:
            key = tuple(sorted(names))
            if key not in made:
                made[key] = Rules(list(key))
            return made[key]

        for b in batches:
            out = []
            for doc, text, maps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = plain(text)
                guess = any(m["rule"] == "stripped" for m in maps or ())
                multi = lambda rule: rule.startswith("utf-8>") or rule == OWN_RUNS
                runs = {m["word"]: m["clean"] for m in maps or () if multi(m["rule"])}
                often = Counter(m["rule"] for m in maps or ())
                marks = {m["word"]: m["clean"] for m in maps or () if m["rule"] == "cp1252>latin-1" and C1.fullmatch(m["word"])}
                # where rules disagree on a word, the one with most words in the document holds
                single = {m["word"]: m["clean"] for m in sorted(maps or (), key=lambda m: (often[m["rule"]], m["rule"])) if not multi(m["rule"]) and m["rule"] != "stripped" and m["word"] not in marks}
                if single:
                    main = max((n for n in often if not multi(n) and n not in ("stripped", "cp1252>latin-1")), key=lambda n: (often[n], n))
                    back = rules_for({main}).back.get(main, {}) if often[main] >= 5 else {}

                    def fix(m: re.Match, single: dict = single, back: dict = back) -> str:
                        """By the mapping; in a document garbled throughout also words that it lacks and that are none as they stand."""
                        w = m.group()
                        if w in single or not back or _wordlike(w):
                            return single.get(w, w)
                        u = "".join(back.get(c, c) for c in w)
                        return u if _wordlike(u) else w

                    text = WORD.sub(fix, text)
                torn = False
                if runs:
                    names = {m["rule"] for m in maps if m["rule"].startswith("utf-8>")}
                    rules = rules_for(names)
                    usual_here = alphabet | frozenset(c for v in runs.values() for c in v)
                    # runs that were judged as they stand; all others came of undoing
                    settled = set(RUN.findall(text)) - runs.keys()
                    lost: set[str] = set()
                    for m in maps:
                        if m["rule"] in names:
                            lost |= rules.leftover(m["word"], m["clean"], m["rule"])
                    text = RUN.sub(lambda m, runs=runs: runs.get(m.group(), m.group()), text)

                    def again(m: re.Match, rules: Rules = rules, usual: frozenset = usual_here, settled: set = settled, lost: set = lost, names: set = names) -> str:
                        r = m.group()
                        if len(r) < 2 or (r in settled and not any(c in "ÃÂâ" for c in r)):
                            return r
                        if hit := rules.undo_multi(r, usual):
                            lost |= rules.leftover(r, *hit)
                            names.add(hit[1])
                            return hit[0]
                        return r

                    while (more := RUN.sub(again, text)) != text:  # garbled repeatedly; each undoing shortens a run
                        text = more
                    torn = any(set(r) & lost or rules.remains(r, names, usual_here) for r in set(RUN.findall(text)) - settled)
                own = [m for m in maps or () if m["rule"] in (OWN_RUNS, OWN_WORDS)]
                if own:  # characters that only garbled words had
                    left = {c for m in own for c in m["word"] if c > "\x7f"} - {c for m in own for c in m["clean"]}
                    torn = torn or not left.isdisjoint(text)
                if C1.search(text):
                    # controls within or after the first byte of a UTF-8 sequence aren't characters of their own
                    text = RUN.sub(lambda m, marks=marks, multi=bool(runs): _controls(m.group(), marks, multi), text)
                    torn = torn or bool(C1.search(text))
                out.append((doc, text, not guess and not torn and MARK not in text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["doc_id", "restored", "whole"])

    rows = documents.filter("text is not null").select("doc_id", "text").join(every, "doc_id")
    return rows.select("doc_id", "text", "maps").mapInArrow(run, RESTORED)


_LATIN = "".join(chr(c) for c in range(0xC0, 0x100)) + STRIPPED + "«»©®°±·€№²³½¼¾"
