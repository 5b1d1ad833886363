"""Vertical text read permissively, and the reasons of the lines that don't parse.

A line is read under the settings of its run (separators, quote character,
undefined value, columns). ``read_lines`` gives every line the explicit schema
of ``FIELDS`` and keeps the raw text of those that don't fit in ``corrupt``;
``reclassify`` then finds the reason of these alone. Spark's CSV reader takes one
separator string and a looser quote rule for a whole file, whereas separators
are character sets here and differ by row, so the permissive read is made of
column expressions; all of it is generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tag letters a `pos` field may hold.
POS = ("N", "V", "A", "D", "P", "R", "C", "X")

SEP = "\u0001"
BAD = "[\\x{00}-\\x{1f}\\x{fffd}]"
NAME = "[\\p{L}\\p{M}\\p{Nd}_.\\-]"
ATTRIBUTE = f"\\G[ \\t]++{NAME}++=(?:\"[^\"]*+\"|'[^']*+'|[^ \\t\"'>]++)"
ELEMENT = f"\\A<[A-Za-z]{NAME}*+"
CLOSE = f"\\A</[A-Za-z]{NAME}*+[ \\t]*+>\\z"
FIELDS = "word string, pos string, lemma string, feats string, freq decimal(38,0)"


def _translate(x: Column, matching: Column, to: Column) -> Column:
    return F.call_function("translate", x, matching, to)


def _is_tag(raw: Column) -> Column:
    return raw.rlike("\\A<(?:/?[A-Za-z]|[!?])")


def _tag_ok(raw: Column) -> Column:
    """Leading attributes are taken off one by one, so their number can't exhaust the stack."""
    opened = F.regexp_replace(F.regexp_replace(raw, ELEMENT, ""), ATTRIBUTE, "")
    return raw.rlike("\\A<[!?]") | raw.rlike(CLOSE) | (raw.rlike("\\A<[A-Za-z]") & opened.rlike("\\A[ \\t]*+/?[ \\t]*+>\\z"))


def _pieces(raw: Column, quote: Column) -> Column:
    """The line cut at its quote characters; odd pieces lie within quotes."""
    return F.when(quote.isNull() | (quote == ""), F.array(raw)).otherwise(F.split(raw, F.concat(F.lit("\\Q"), quote, F.lit("\\E")), -1))


def _plain(x: Column, seps: Column) -> Column:
    """Every separator as SEP. Text outside quotes that holds SEP itself is told apart beforehand."""
    return _translate(x, seps, F.repeat(F.lit(SEP), F.length(seps)))


def _has(x: Column, seps: Column) -> Column:
    return (x != "") & (_translate(x, seps, F.lit("")) == "")


def read_lines(lines: DataFrame, runs: DataFrame, line: str = "raw_line", run: str = "run_id") -> DataFrame:
    """All columns of ``lines``, then ``kind``, ``fields``, ``record`` (FIELDS) and ``corrupt``.

    kind is ``token``, ``tag`` or null (null line, or a run without settings).
    fields holds a token line's fields in column order, as delivered but for
    quoting. record holds the named ones, those empty or equal to the undefined
    value as null; a freq beyond 38 digits is null there and whole in fields.
    corrupt is the raw text of a line that isn't of the form, else null; a null
    line or a line without settings is corrupt with the text "" .
    A column of ``lines`` with one of these names (or a setting's) is kept under ``in_`` + name.
    Settings are few (one row a run); they are joined by broadcast if Spark
    finds them below its limit, otherwise by a sort-merge join whose hot runs
    adaptive execution splits. Of several settings for a run_id the least is taken.
    """
    own = {"kind", "fields", "record", "corrupt", "field_separators", "undef_value", "quote_char", "column_names"}
    for c in lines.columns:
        if c.lower() in own or c.startswith("_t_"):
            lines = lines.withColumnRenamed(c, f"in_{c}")
    settings = runs.groupBy(F.col("run_id").alias("_t_run")).agg(
        F.min(F.struct(*[F.col(c).alias(f"_t_{a}") for c, a in (("field_separators", "seps"), ("undef_value", "undef"), ("quote_char", "quote"), ("column_names", "names"))])).alias("_t_s")
    )
    df = lines.join(settings, F.col(run) == F.col("_t_run"), "left")
    raw, s = F.col(line), F.col("_t_s")
    seps, undef, quote = F.coalesce(s["_t_seps"], F.lit("\t")), s["_t_undef"], s["_t_quote"]
    df = _once(
        df,
        "_t_1",
        kind=F.when(raw.isNull() | s.isNull(), None).when(_is_tag(raw), "tag").otherwise("token"),
        names=F.split(F.trim(s["_t_names"]), " +"),
        pieces=F.when(raw.isNotNull() & s.isNotNull() & ~_is_tag(raw), _pieces(raw, quote)),
    )
    p, names, token = F.col("_t_1.pieces"), F.col("_t_1.names"), F.col("_t_1.kind") == "token"
    last = F.size(p) - 1
    even = lambda i: (i % 2) == 0
    # outside text: a piece between two quoted fields begins and ends with a separator; an empty one is a doubled quote
    sound = (last == 0) | (
        even(last)
        & F.forall(
            F.transform(p, lambda x, i: ~even(i) | (x == "") | (((i == 0) | _has(F.substring(x, 1, 1), seps)) & ((i == last) | _has(F.right(x, F.lit(1)), seps)))),
            lambda ok: ok,
        )
    )
    outside = F.when(last == 0, p[0]).otherwise(F.concat_ws("", F.filter(p, lambda x, i: even(i))))
    inside = F.when(last == 0, F.lit("")).otherwise(F.concat_ws("", F.filter(p, lambda x, i: ~even(i))))
    joined = F.when(last == 0, _plain(p[0], seps)).otherwise(
        F.array_join(F.transform(p, lambda x, i: F.when(~even(i), x).when((x == "") & (i > 0) & (i < last), quote).otherwise(_plain(x, seps))), "")
    )
    df = _once(df, "_t_2", sound=sound, rest=_translate(outside, seps, F.lit("")), outside=F.length(outside), inside=inside, fields=F.when(token, F.split(joined, SEP, -1)))
    t = F.col("_t_2")
    df = _once(
        df,
        "_t_3",
        counted=t["outside"] - F.length(t["rest"]) + 1 == F.size(names),
        clean=~t["rest"].rlike(BAD) & ~t["inside"].rlike(BAD),
        **{name: _field(t["fields"], names, name) for name in ("word", "pos", "lemma", "feats", "freq")},
    )
    f = F.col("_t_3")

    def value(name: str) -> Column:
        return F.when((f[name] == "") | f[name].eqNullSafe(undef), None).otherwise(f[name])

    df = _once(df, "_t_4", **{name: value(name) for name in ("word", "pos", "lemma", "feats", "freq")})
    v = F.col("_t_4")
    feats = v["feats"]
    fits = (
        f["clean"]
        & ((F.array_position(names, F.lit("word")) == 0) | v["word"].isNotNull())
        & (v["pos"].isNull() | v["pos"].isin(*POS))
        & (feats.isNull() | (feats == "|") | (feats.startswith("|") & feats.endswith("|") & ~feats.contains("||") & (F.length(feats) > 2)))
        & (v["freq"].isNull() | v["freq"].rlike("\\A0*+[1-9][0-9]*+\\z"))
    )
    df = _once(df, "_t_5", fits=F.coalesce(fits, F.lit(False)), tag=F.when(F.col("_t_1.kind") == "tag", _tag_ok(raw)))
    ok = F.coalesce(F.when(token, t["sound"] & f["counted"] & F.col("_t_5.fits")).otherwise(F.col("_t_5.tag")), F.lit(False))
    df = _once(df, "_t_6", ok=ok)
    good = F.col("_t_6.ok") & token
    return df.withColumns(
        {
            "kind": F.col("_t_1.kind"),
            "fields": F.when(good, t["fields"]),
            "record": F.when(good, F.struct(v["word"].alias("word"), v["pos"].alias("pos"), v["lemma"].alias("lemma"), feats.alias("feats"), v["freq"].try_cast("decimal(38,0)").alias("freq"))),
            "corrupt": F.when(~F.col("_t_6.ok"), F.coalesce(raw, F.lit(""))),
        }
    )


def _once(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """``columns`` as a struct that is computed once: filters and projections above aren't inlined through a generator."""
    return df.withColumn(name, F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _field(fields: Column, names: Column, name: str) -> Column:
    at = F.array_position(names, F.lit(name)).cast("int")
    return F.when(at > 0, F.try_element_at(fields, at))


def _public(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_t_")])


def valid_lines(read: DataFrame) -> DataFrame:
    """The lines that were loaded: columns of the input, kind, fields and record."""
    return _public(read.filter("corrupt is null")).drop("corrupt")


def reclassify(read: DataFrame) -> DataFrame:
    """The corrupt lines with their ``reason``, the first that applies:

    ``settings``  the run has no row among the settings
    ``quoting``  broken quoting in a token line, or a tag line not of the form
    ``column_count``  another number of fields than columns; also a null line
    ``value``  a field that its column doesn't allow
    """
    raw_null = F.col("kind").isNull()
    reason = (
        F.when(raw_null & F.col("_t_s").isNull(), "settings")
        .when(raw_null, "column_count")
        .when((F.col("kind") == "tag") | ~F.col("_t_2.sound"), "quoting")
        .when(~F.col("_t_3.counted"), "column_count")
        .otherwise("value")
    )
    return _public(read.filter("corrupt is not null").withColumn("reason", reason)).drop("fields", "record")
