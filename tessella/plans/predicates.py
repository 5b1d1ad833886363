"""Token constraints: compiled to columns, or evaluated per position where labels are involved."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import featuresets, scalar
from tessella.functions.regex import RegexError, element_pattern, is_literal, matches, set_contains, set_matches
from tessella.functions.folding import fold_text
from tessella.plans.language import Bool, Call, Exists, Int, Ref, Rel, Str, Var


class BindError(ValueError):
    pass


class Compiler:
    """Constraint to boolean Column on token rows; undefined operands make a comparison false, never null."""

    def __init__(self, patts: tuple[str, ...], satts: tuple[str, ...], variables: Mapping[str, set[str]] | None = None, prefix: str = "", functions: Mapping[str, object] | None = None) -> None:
        self.patts, self.satts, self.variables, self.prefix = patts, satts, variables or {}, prefix
        self.functions = functions or {}

    def col(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}")

    def test(self, node: object | None) -> Column:
        if node is None:
            return F.lit(True)
        if isinstance(node, Bool):
            args = [self.test(a) for a in node.args]
            if node.op == "!":
                return ~args[0]
            if node.op == "->":
                return ~args[0] | args[1]
            out = args[0]
            for a in args[1:]:
                out = out & a if node.op == "&" else out | a
            return out
        if isinstance(node, Exists):
            return self._exists(node.of)
        if isinstance(node, Rel):
            return F.coalesce(self._relation(node), F.lit(False))
        raise BindError(f"not a constraint: {node}")

    def _exists(self, of: object) -> Column:
        kind, value = self.value(of)
        if kind == "int":
            return F.coalesce(value != 0, F.lit(False))
        if kind == "pos":
            return F.coalesce(value >= 0, F.lit(False))
        return value.isNotNull()

    def _relation(self, r: Rel) -> Column:
        left, right = r.left, r.right
        if isinstance(left, (Str, Var)) and not isinstance(right, (Str, Var)):
            left, right = right, left
        kind, a = self.value(left)
        if isinstance(right, Var):
            return self._in(a, right, r)
        if isinstance(right, Str):
            if kind not in ("str", "none"):
                raise BindError("a string is compared with a number")
            if r.op in ("contains", "matches"):
                hit = (set_contains if r.op == "contains" else set_matches)(a, right.text, right.flags)
                return ~hit if r.negated else hit
            if r.op not in ("=", "!="):
                raise BindError(f"strings have no {r.op}")
            hit = matches(a, right.text, right.flags)
            return ~hit if r.op == "!=" else hit
        other, b = self.value(right)
        numeric = {"int", "pos"}
        if (kind in numeric) != (other in numeric):
            raise BindError("a string is compared with a number")
        if kind == "str" and r.op not in ("=", "!="):
            raise BindError(f"strings have no {r.op}")
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[r.op]

    def _in(self, a: Column, v: Var, r: Rel) -> Column:
        if v.name not in self.variables:
            raise BindError(f"${v.name} isn't defined")
        items = sorted(self.variables[v.name])
        negative = (r.op == "!=") != r.negated
        if v.as_regex:
            hit = matches(a, "|".join(f"(?:{x})" for x in items), v.flags) if items else F.lit(False)
            if r.op == "contains" and items:
                hit = set_contains(a, "|".join(items), v.flags)
            return ~hit if negative else hit
        if not items:
            return F.lit(negative)
        hit = a.isin(items)
        return ~hit if negative else hit

    def value(self, node: object) -> tuple[str, Column]:
        if isinstance(node, Int):
            return "int", F.lit(node.value)
        if isinstance(node, Str):
            return "str", F.lit(node.text)
        if isinstance(node, Ref):
            if node.label not in (None, "_"):
                raise BindError(f"label {node.label} can't be used here")
            if node.name == "_":
                return "pos", self.col("cpos")
            if node.name in self.patts:
                return "str", self.col(node.name)
            if node.name in self.satts:
                if node.label:
                    return "str", self.col(f"{node.name}_value")
                return "int", scalar.region_flags(self.col("cpos"), self.col(f"{node.name}_start"), self.col(f"{node.name}_end"))
            raise BindError(f"unknown attribute {node.name}")
        if isinstance(node, Call):
            return self._call(node)
        raise BindError(f"not a value: {node}")

    def _call(self, c: Call) -> tuple[str, Column]:
        n = c.name
        if n in self.functions:
            return "str", self.functions[n](*[self.value(a)[1] for a in c.args])
        if n == "f":
            if len(c.args) != 1 or not isinstance(c.args[0], Ref):
                raise BindError("f() takes an attribute")
            return "int", self.col(f"f_{c.args[0].name}")
        if n in ("lbound", "rbound"):
            s = c.args[0].name
            return "int", F.coalesce(self.col("cpos") == self.col(f"{s}_start" if n == "lbound" else f"{s}_end"), F.lit(False)).cast("long")
        if n in ("lbound_of", "rbound_of"):
            s = c.args[0].name
            return "pos", self.col(f"{s}_start" if n == "lbound_of" else f"{s}_end")
        if n == "ignore":
            return "int", F.lit(1)
        arity = ARITY.get(n)
        if arity is None or arity != len(c.args):
            raise BindError(f"{n}() is unknown or takes another number of arguments")
        if n == "normalize":
            return "str", scalar.normalize(self.value(c.args[0])[1], c.args[1].text)
        a = [self.value(x)[1] for x in c.args]
        return {
            "distance": lambda: ("int", scalar.distance(*a)), "dist": lambda: ("int", scalar.distance(*a)), "distabs": lambda: ("int", scalar.distabs(*a)),
            "int": lambda: ("int", scalar.to_int(*a)), "unify": lambda: ("str", featuresets.unify(*a)), "ambiguity": lambda: ("int", featuresets.ambiguity(*a)),
            "add": lambda: ("int", a[0] + a[1]), "sub": lambda: ("int", a[0] - a[1]), "mul": lambda: ("int", a[0] * a[1]),
            "prefix": lambda: ("str", scalar.prefix(*a)), "is_prefix": lambda: ("int", scalar.is_prefix(*a)), "minus": lambda: ("str", scalar.minus(*a)),
        }[n]()


# The arguments that functions take.
ARITY = {"distance": 2, "dist": 2, "distabs": 2, "int": 1, "unify": 2, "ambiguity": 1, "add": 2, "sub": 2, "mul": 2, "prefix": 2, "is_prefix": 2, "minus": 2, "normalize": 2}


def calls_of(node: object) -> list[Call]:
    if isinstance(node, Call):
        return [node] + [c for a in node.args for c in calls_of(a)]
    if isinstance(node, Rel):
        return calls_of(node.left) + calls_of(node.right)
    if isinstance(node, Exists):
        return calls_of(node.of)
    if isinstance(node, Bool):
        return [c for a in node.args for c in calls_of(a)]
    return []


POINTS = ("lbound", "rbound", "lbound_of", "rbound_of")


class AtOffsets(Compiler):
    """Constraints within a match whose labels stand at known offsets from its start.

    A column of the token at offset k is named ``<column>__k``; ``used`` collects (column, k).
    ``here`` is the offset of the token under test, None in a global constraint.
    """

    def __init__(self, of: Compiler, labels: Mapping[str, int], here: int | None, used: set[tuple[str, int]]) -> None:
        super().__init__(of.patts, of.satts, of.variables, functions=of.functions)
        self.labels, self.here, self.used = labels, here, used

    def at(self, name: str, k: int | None) -> Column:
        if k is None:
            return F.lit(None).cast("long" if name.startswith("f_") or name == "cpos" or name.endswith(("_start", "_end")) else "string")
        if name == "cpos":
            return F.col("cpos") + k
        self.used.add((name, k))
        return F.col(f"{name}__{k}".replace("-", "m"))

    def col(self, name: str) -> Column:
        return self.at(name, self.here)

    def _offset(self, label: str | None) -> int | None:
        return self.here if label in (None, "_") else self.labels.get(label)

    def value(self, node: object) -> tuple[str, Column]:
        if isinstance(node, Ref):
            if node.label not in (None, "_"):
                return "str", self.at(node.name if node.name in self.patts else f"{node.name}_value", self._offset(node.label))
            if node.label is None and (node.name in self.labels or node.name not in (*self.patts, *self.satts, "_")):
                # an unset label by itself is position -1
                return "pos", F.col("cpos") + self.labels[node.name] if node.name in self.labels else F.lit(-1).cast("long")
        if isinstance(node, Call) and node.name not in self.functions:
            if node.name in POINTS and len(node.args) > 1:
                k = self._offset(node.args[1].name)
                edge = self.at(f"{node.args[0].name}_{'start' if node.name[0] == 'l' else 'end'}", k)
                return ("pos", edge) if node.name.endswith("_of") else ("int", F.coalesce(self.at("cpos", k) == edge, F.lit(False)).cast("long"))
            if node.name == "f" and node.args[0].label is not None:
                return "int", self.at(f"f_{node.args[0].name}", self._offset(node.args[0].label))
        return super().value(node)


@dataclass(frozen=True)
class Known:
    """A value or truth that Spark has worked out for every token: its column, and the label whose token is meant (None: the one under test)."""

    kind: str  # bool, int, pos, str
    column: str
    label: str | None


def hoist(node: object, compiler: Compiler, columns: dict[str, Column]) -> object:
    """``node`` with all that depends on one token alone as ``Known``; the columns it takes are added to ``columns``.

    Tasks then compare values of different labels only: patterns, variables and
    functions are Spark's, with labels or without.
    """
    known: dict[tuple, Known] = {}

    def put(kind: str, of: object, label: str | None, column: Column) -> Known:
        key = (kind, of)
        if key not in known:
            name = f"_h{len(columns)}"
            columns[name] = column
            known[key] = Known(kind, name, None)
        return replace(known[key], label=label)

    def owner(x: object) -> tuple[str | None, ...]:
        """Labels of the tokens that ``x`` reads; "?" where it is about positions or deletes a label."""
        if isinstance(x, (Int, Str, Var)):
            return ()
        if isinstance(x, Ref):
            if x.delete:
                return ("?",)
            if x.label is not None:
                return (None if x.label == "_" else x.label,)
            return (None,) if x.name in compiler.patts or x.name in compiler.satts else ("?",)
        if isinstance(x, Call):
            if x.name in POINTS and x.name not in compiler.functions:
                return (None,) if len(x.args) < 2 else (x.args[1].name,) if isinstance(x.args[1], Ref) and not x.args[1].delete and x.args[1].label is None else ("?",)
            return tuple(dict.fromkeys(o for a in x.args for o in owner(a)))
        if isinstance(x, Rel):
            return tuple(dict.fromkeys((*owner(x.left), *owner(x.right))))
        if isinstance(x, Exists):
            return owner(x.of)
        return ("?",)

    def plain(x: object) -> object:
        """Without labels: the token itself is meant."""
        if isinstance(x, Ref):
            return Ref(x.name, "_") if x.label is not None else x
        if isinstance(x, Call):
            return Call(x.name, x.args[:1] if x.name in POINTS and x.name not in compiler.functions else tuple(map(plain, x.args)))
        if isinstance(x, Rel):
            return Rel(x.op, plain(x.left), plain(x.right), x.negated)
        return Exists(plain(x.of)) if isinstance(x, Exists) else x

    def value(x: object) -> object:
        if isinstance(x, (Ref, Call)) and len(who := owner(x)) == 1 and who != ("?",):
            bare = plain(x)
            kind, column = compiler.value(bare)
            return put(kind, bare, who[0], column)
        return Call(x.name, tuple(map(value, x.args))) if isinstance(x, Call) else x

    def test(x: object) -> object:
        if isinstance(x, Bool):
            return Bool(x.op, tuple(map(test, x.args)))
        if len(who := owner(x)) == 1 and who != ("?",):
            bare = plain(x)
            return put("bool", bare, who[0], compiler.test(bare))
        return Exists(value(x.of)) if isinstance(x, Exists) else Rel(x.op, value(x.left), value(x.right), x.negated)

    return test(node)


class Evaluator:
    """What ``hoist`` left of a constraint, at one position with labels; runs in the tasks of the pattern engine.

    ``get(column, cpos)`` gives a column's value of a token, or None.
    """

    def __init__(self, variables: Mapping[str, set[str]], get) -> None:
        self.variables, self.get = variables, get
        self.compiled: dict[tuple, object] = {}

    def test(self, node: object, at: int | None, labels: dict, gone: set | None = None) -> bool:
        if isinstance(node, Known):
            return bool(self.value(node, at, labels, gone)[1])
        if isinstance(node, Bool):
            if node.op == "!":
                return not self.test(node.args[0], at, labels, gone)
            if node.op == "&":
                return all(self.test(a, at, labels, gone) for a in node.args)
            if node.op == "|":
                return any(self.test(a, at, labels, gone) for a in node.args)
            return not self.test(node.args[0], at, labels, gone) or self.test(node.args[1], at, labels, gone)
        if isinstance(node, Exists):
            kind, v = self.value(node.of, at, labels, gone)
            return v is not None and (v != 0 if kind == "int" else v >= 0 if kind == "pos" else True)
        return self._relation(node, at, labels, gone)

    def _relation(self, r: Rel, at: int | None, labels: dict, gone: set | None) -> bool:
        left, right = r.left, r.right
        if isinstance(left, (Str, Var)) and not isinstance(right, (Str, Var)):
            left, right = right, left
        _, a = self.value(left, at, labels, gone)
        if a is None:
            return False
        if isinstance(right, Var):
            if not isinstance(a, str):
                raise BindError("a string is compared with a number")
            items = self.variables[right.name]
            if right.as_regex:
                hit = any(self._matches(a, Str(x, right.flags), "contains" if r.op == "contains" else "re") for x in items)
            else:
                hit = a in items
            return hit != ((r.op == "!=") != r.negated)
        if isinstance(right, Str):
            if not isinstance(a, str):
                raise BindError("a string is compared with a number")
            hit = self._matches(a, right, r.op)
            return hit != (r.op == "!=" or r.negated)
        _, b = self.value(right, at, labels, gone)
        if b is None:
            return False
        if isinstance(a, str) != isinstance(b, str):
            raise BindError("a string is compared with a number")
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[r.op]

    def _matches(self, value: str, s: Str, op: str) -> bool:
        """Only for values that several labels go into, such as an intersection."""
        key = (s, op)
        if key not in self.compiled:
            import regex

            p = s.text
            if op in ("contains", "matches") and "l" in s.flags:
                raise RegexError("%l can't be used with contains or matches")
            if op == "contains":
                p = f".*\\|(?:{element_pattern(p)})\\|.*"
            elif op == "matches":
                p = f"\\|(?:(?:{element_pattern(p)})\\|)+"
            elif op != "re" and ("l" in s.flags or (not s.flags and is_literal(p))):
                p = re.escape(s.text)
            if "d" in s.flags:
                p = fold_text(p, "d")
            self.compiled[key] = regex.compile(p, regex.I if "c" in s.flags else 0)
        if "d" in s.flags:
            value = fold_text(value, "d")
        return self.compiled[key].fullmatch(value) is not None

    def value(self, node: object, at: int | None, labels: dict, gone: set | None) -> tuple[str, object]:
        if isinstance(node, Known):
            pos = at if node.label is None else labels.get(node.label)
            return node.kind, None if pos is None else self.get(node.column, pos)
        if isinstance(node, Int):
            return "int", node.value
        if isinstance(node, Str):
            return "str", node.text
        if isinstance(node, Ref):
            if node.delete and gone is not None:
                gone.add(node.label or node.name)
            # an unset label by itself is position -1
            return "pos", at if node.name == "_" else labels.get(node.name, -1)
        n = node.name
        a = [self.value(x, at, labels, gone)[1] for x in node.args]
        if n == "ignore":
            return "int", 1
        if n in ("distance", "dist", "distabs"):
            x, y = (-1 if v is None else v for v in a)
            return "int", abs(y - x) if n == "distabs" else y - x
        if n in ("ambiguity", "unify"):
            return self._sets(n, a)
        if any(v is None for v in a):
            return "none", None
        if n == "int":
            m = re.match(r"\s*([+-]?\d+)", a[0])
            return "int", int(m[1]) if m else 0
        if n in ("add", "sub", "mul"):
            return "int", a[0] + a[1] if n == "add" else a[0] - a[1] if n == "sub" else a[0] * a[1]
        if n == "normalize":
            return "str", fold_text(a[0], a[1].lstrip("%"))
        if n == "is_prefix":
            return "int", int(a[1].startswith(a[0]))
        if n in ("prefix", "minus"):
            k = 0
            while k < min(len(a[0]), len(a[1])) and a[0][k] == a[1][k]:
                k += 1
            return "str", a[0][:k] if n == "prefix" else a[0][k:]
        raise BindError(f"{n}() can't take several labels, or is unknown")

    @staticmethod
    def _sets(n: str, a: list) -> tuple[str, object]:
        if n == "unify" and a[1] is None:
            raise BindError("unify() with an undefined second set")
        if a[0] is None:
            return ("int", 0) if n == "ambiguity" else ("str", a[1])
        if not all(re.fullmatch(r"\|(?:[^|]+\|)*", v, re.S) for v in a):
            raise BindError(f"{n}() of a malformed set")
        if n == "ambiguity":
            return "int", a[0].count("|") - 1
        there, both = a[1].split("|")[1:-1], []
        for e in sorted(a[0].split("|")[1:-1]):
            if e in there:
                there.remove(e)
                both.append(e)
        return "str", "|" + "".join(e + "|" for e in both)
