"""Typed translation of expressions to Spark columns. Everything stays built-in, so plans stay in generated code.

Types are ``bigint``, ``string``, ``null`` (an untyped NULL), ``boolean`` (predicates) and, for columns of other files, any
other Spark type, which may be selected, compared with its like and, if numeric, computed with.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.errors import BindError
from larkspan.plans import ast as A

NUMERIC = ("bigint", "double", "float")


@dataclass(frozen=True)
class Field:
    """A column in scope: its name, the names of its table, its type, and the DataFrame column that holds it."""

    name: str
    type: str
    physical: str
    tables: tuple[str, ...] = ()


@dataclass(frozen=True)
class Typed:
    col: Column
    type: str

    def value(self) -> Column:
        """As a value: a predicate is 1, 0 or NULL."""
        return self.col.cast("bigint") if self.type == "boolean" else self.col

    @property
    def value_type(self) -> str:
        return "bigint" if self.type == "boolean" else self.type


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Compiler:
    """Binds names in ``fields`` and builds columns. ``known`` gives columns for whole expressions, as those of a grouped result."""

    def __init__(self, fields: Sequence[Field], known: dict[A.Expr, Typed] | None = None, strict_refs: str = ""):
        self.fields, self.known, self.strict_refs = fields, known or {}, strict_refs

    def field(self, ref: A.Ref) -> Field:
        got = [f for f in self.fields if f.name == ref.name and (ref.table is None or ref.table in f.tables)]
        if not got:
            raise BindError(f"unknown column {A.label(ref)}")
        if len(got) > 1:
            raise BindError(f"column {ref.name} is ambiguous")
        return got[0]

    def predicate(self, e: A.Expr) -> Column:
        """As a condition: non-zero integers hold, text does not stand for a condition."""
        t = self.typed(e)
        if t.type == "boolean":
            return t.col
        if t.type == "null":
            return F.lit(None).cast("boolean")
        if t.type in NUMERIC:
            return t.col != 0
        raise BindError(f"{A.label(e)} is {t.type}, not a condition")

    def value(self, e: A.Expr) -> Column:
        return self.typed(e).value()

    def typed(self, e: A.Expr) -> Typed:
        if e in self.known:
            return self.known[e]
        match e:
            case A.Lit(None):
                return Typed(F.lit(None), "null")
            case A.Lit(str() as s):
                return Typed(F.lit(s), "string")
            case A.Lit(n):
                return Typed(F.lit(n).cast("bigint"), "bigint")
            case A.Ref():
                if self.strict_refs:
                    raise BindError(f"column {e.name} {self.strict_refs}")
                f = self.field(e)
                return Typed(F.col(quoted(f.physical)), f.type)
            case A.Not(a):
                return Typed(~self.predicate(a), "boolean")
            case A.Neg(a):
                return self._arith(e, [a], lambda x: -x)
            case A.IsNull(a):
                return Typed(self.value(a).isNull(), "boolean")
            case A.Bin("AND", a, b):
                return Typed(self.predicate(a) & self.predicate(b), "boolean")
            case A.Bin("OR", a, b):
                return Typed(self.predicate(a) | self.predicate(b), "boolean")
            case A.Bin("LIKE", a, b):
                return Typed(self._like(e, a, b), "boolean")
            case A.Bin(op, a, b) if op in "+-*/%":
                return self._arith(e, [a, b], _ARITH[op], op)
            case A.Bin(op, a, b):
                return Typed(self._compare(self.typed(a), self.typed(b), _COMPARE[op]), "boolean")
            case A.Between(a, lo, hi):
                return Typed(self._between(a, lo, hi), "boolean")
            case A.InList(a, items):
                return Typed(self._in(a, items), "boolean")
            case A.Case(whens, other):
                return self._case(e, whens, other)
            case A.Call():
                return self._call(e)
        raise BindError(f"{e!r} cannot be bound")

    def _compare(self, a: Typed, b: Typed, op: Callable[[Column, Column], Column]) -> Column:
        """NULL where a side is NULL or the types differ; nothing is coerced."""
        s, t = a.value_type, b.value_type
        if not _comparable(s, t):
            return F.lit(None).cast("boolean")
        return op(a.value(), b.value())

    def _like(self, e: A.Expr, a: A.Expr, b: A.Expr) -> Column:
        s, p = self.typed(a), self.typed(b)
        for x in (s, p):
            if x.type not in ("string", "null"):
                raise BindError(f"LIKE needs text in {A.label(e)}")
        if "null" in (s.type, p.type):
            return F.lit(None).cast("boolean")
        return F.like(s.col, p.col, F.lit("\x01"))  # % and _ only: the escape character does not occur in text

    def _between(self, a: A.Expr, lo: A.Expr, hi: A.Expr) -> Column:
        """UNKNOWN unless both bounds can be compared."""
        x = self.typed(a)
        low = self._compare(x, self.typed(lo), lambda p, q: p >= q)
        high = self._compare(x, self.typed(hi), lambda p, q: p <= q)
        return F.when(low.isNull() | high.isNull(), F.lit(None).cast("boolean")).otherwise(low & high)

    def _in(self, a: A.Expr, items: tuple[A.Expr, ...]) -> Column:
        """Equal by value to an item: true; else NULL if an item is NULL; else false, for a NULL operand too."""
        x = self.typed(a)
        hit, null = F.lit(False), F.lit(False)
        plain = [i.value for i in items if isinstance(i, A.Lit) and i.value is not None and _comparable(_lit_type(i), x.value_type)]
        if plain:
            hit = F.coalesce(x.value().isin(plain), F.lit(False))  # one IN that the scan can use
        for i in items:
            if isinstance(i, A.Lit):
                null = F.lit(True) if i.value is None else null
                continue
            t = self.typed(i)
            null = null | t.value().isNull()
            hit = hit | F.coalesce(self._compare(x, t, lambda p, q: p == q), F.lit(False))
        return F.when(hit, F.lit(True)).when(null, F.lit(None).cast("boolean")).otherwise(F.lit(False)) if any(not isinstance(i, A.Lit) or i.value is None for i in items) else hit

    def _arith(self, e: A.Expr, args: list[A.Expr], op: Callable[..., Column], sign: str = "-") -> Typed:
        ts = [self.typed(a) for a in args]
        for t in ts:
            if t.value_type not in (*NUMERIC, "null"):
                raise BindError(f"{sign} needs integers in {A.label(e)}")
        if any(t.value_type not in ("bigint", "null") for t in ts):
            cols = [t.value().cast("double") for t in ts]
            return Typed(cols[0] / cols[1] if sign == "/" else op(*cols), "double")
        return Typed(op(*(t.value().cast("bigint") if t.type == "null" else t.value() for t in ts)), "bigint")

    def _case(self, e: A.Expr, whens: tuple, other: A.Expr | None) -> Typed:
        results = [self.typed(t) for _, t in whens] + ([self.typed(other)] if other else [])
        kinds = {t.value_type for t in results} - {"null"}
        if len(kinds) > 1:
            raise BindError(f"results of {A.label(e)} have different types")
        kind = kinds.pop() if kinds else "null"
        cols = [t.value().cast(kind) if t.type == "null" and kind != "null" else t.value() for t in results]
        out = F.when(self.predicate(whens[0][0]), cols[0])
        for (w, _), c in zip(whens[1:], cols[1:]):
            out = out.when(self.predicate(w), c)
        return Typed(out.otherwise(cols[-1]) if other else out, kind)

    def _call(self, e: A.Call) -> Typed:
        name = e.name.upper()
        if name in A.AGGREGATES:
            raise BindError(f"{A.label(e)} is not allowed here")
        if name not in _SCALAR:
            raise BindError(f"unsupported function {name}")
        if len(e.args) != 1 or e.star or e.distinct:
            raise BindError(f"{name} takes one argument")
        t = self.typed(e.args[0])
        if t.type not in ("string", "null"):
            raise BindError(f"{name} needs text in {A.label(e)}")
        fn, kind = _SCALAR[name]
        return Typed(fn(t.col.cast("string")), kind)

    def aggregate(self, e: A.Call) -> Typed:
        """An aggregate over the rows in scope. AVG of integers is an integer, cut toward zero."""
        name = e.name.upper()
        if e.star:
            if name != "COUNT":
                raise BindError(f"{name}(*) is not an aggregate")
            return Typed(F.count(F.lit(1)), "bigint")
        if len(e.args) != 1:
            raise BindError(f"{name} takes one argument")
        if A.has_aggregate(e.args[0]):
            raise BindError("aggregates do not nest")
        t = self.typed(e.args[0])
        col, kind = t.value(), t.value_type
        if name == "COUNT":
            return Typed(F.count_distinct(col) if e.distinct else F.count(col), "bigint")
        if name in ("MIN", "MAX"):
            if kind == "null":
                return Typed(F.lit(None), "null")
            return Typed(F.min(col) if name == "MIN" else F.max(col), kind)
        if kind not in (*NUMERIC, "null"):
            raise BindError(f"{name} needs integers in {A.label(e)}")
        if kind == "null":
            return Typed(F.max(F.lit(None).cast("bigint")), "bigint")
        total = F.sum_distinct(col) if e.distinct else F.sum(col)
        if name == "SUM":
            return Typed(total, "bigint" if kind == "bigint" else "double")
        if kind != "bigint":
            return Typed(F.avg(col), "double")
        return Typed(_div(total, F.count_distinct(col) if e.distinct else F.count(col)), "bigint")


def _comparable(s: str, t: str) -> bool:
    return "null" not in (s, t) and (s == t or s in NUMERIC and t in NUMERIC)


def _lit_type(e: A.Lit) -> str:
    return "string" if isinstance(e.value, str) else "bigint"


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


_ARITH = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _div, "%": lambda a, b: a % b}
_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_SCALAR = {"UPPER": (F.upper, "string"), "LOWER": (F.lower, "string"), "LENGTH": (lambda c: F.length(c).cast("bigint"), "bigint")}
