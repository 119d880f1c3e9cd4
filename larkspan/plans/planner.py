"""Bound queries as DataFrames. All name and type errors are raised here, before any row is read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.errors import BindError
from larkspan.functions.exprs import Compiler, Field, Typed, quoted
from larkspan.operators import relational as R
from larkspan.plans import ast as A

#: Hidden column with the order of insertion.
RID = "_rid"

#: Rows of an unfiltered LIMIT that one task reads alone.
FEW = 1 << 16


@dataclass(frozen=True)
class Relation:
    """A table as the planner sees it; ``rid`` tells whether rows bear :data:`RID`."""

    df: DataFrame
    rid: bool = False


Resolver = Callable[[str], Relation]


@dataclass
class Planned:
    df: DataFrame
    types: list[str]


def type_name(spark_type: str) -> str:
    return "bigint" if spark_type in ("tinyint", "smallint", "int", "bigint") else spark_type


class Planner:
    """``settled``: also order rows where SQL leaves it open (insertion order, group keys), for users who look at results."""

    def __init__(self, resolve: Resolver, settled: bool = False):
        self.resolve, self.settled = resolve, settled

    def plan(self, q: A.Query) -> Planned:
        return self.set_op(q) if isinstance(q, A.SetOp) else self.select(q)

    def set_op(self, q: A.SetOp) -> Planned:
        left, right = self.plan(q.left), self.plan(q.right)
        if len(left.types) != len(right.types):
            raise BindError(f"{q.op} needs as many columns on either side")
        for a, b in zip(left.types, right.types):
            if a != b and "null" not in (a, b):
                raise BindError(f"{q.op} of {a} and {b}")
        df = R.set_operation(left.df, right.df, q.op, q.all)
        fields = [Field(n, t, n) for n, t in zip(df.columns, left.types)]
        c = Compiler(fields)
        if q.order:
            df = R.sort(df, [(c.value(o.expr), o.desc) for o in q.order])
        return Planned(R.limit(df, q.limit, q.offset), left.types)

    def scan(self, ref: A.TableRef, at: int) -> tuple[DataFrame, list[Field], list[str]]:
        rel = self.resolve(ref.name)
        fields, cols = [], []
        for f in rel.df.schema.fields:
            if f.name == RID and rel.rid:
                continue
            kind = type_name(f.dataType.simpleString())
            col, physical = F.col(quoted(f.name)), f"t{at}.{f.name}"
            cols.append((col.cast("bigint") if kind == "bigint" and f.dataType.simpleString() != "bigint" else col).alias(physical))
            fields.append(Field(f.name, kind, physical, (ref.alias or ref.name,)))
        rid = [f"t{at}.{RID}."] if rel.rid and self.settled else []
        return rel.df.select(*cols, *[F.col(RID).alias(r) for r in rid]), fields, rid

    def from_clause(self, q: A.Select) -> tuple[DataFrame, list[Field], list[str]]:
        df, fields, rids = self.scan(q.table, 0)
        names = [q.table.alias or q.table.name]
        for k, j in enumerate(q.joins, 1):
            right, more, rid = self.scan(j.table, k)
            name = j.table.alias or j.table.name
            if name in names:
                raise BindError(f"table {name} is named twice; give it an alias")
            names.append(name)
            if j.kind == "cross":
                df = df.crossJoin(right)
            else:
                c = Compiler([*fields, *more])
                for e in A.walk(j.on):
                    if isinstance(e, A.Call) and A.is_aggregate(e):
                        raise BindError("ON takes no aggregates")
                if not self._links(j.on, fields, more):
                    raise BindError("JOIN needs an equality of one column from each table in ON")
                df = df.join(right, c.predicate(j.on), {"left": "left_outer", "right": "right_outer", "full": "full_outer"}.get(j.kind, j.kind))
            fields, rids = [*fields, *more], [*rids, *rid]
        return df, fields, rids

    def _links(self, on: A.Expr, left: list[Field], right: list[Field]) -> bool:
        match on:
            case A.Bin("AND", a, b):
                return self._links(a, left, right) or self._links(b, left, right)
            case A.Bin("=", A.Ref() as a, A.Ref() as b):
                both = Compiler([*left, *right])
                return (both.field(a) in left) != (both.field(b) in left)
        return False

    def items(self, q: A.Select, fields: Sequence[Field]) -> list[tuple[A.Expr | Field, str]]:
        """Select items with their labels; stars expand to fields."""
        out: list[tuple[A.Expr | Field, str]] = []
        for item in q.items:
            if item.expr is not None:
                out.append((item.expr, item.alias or A.label(item.expr)))
                continue
            got = [f for f in fields if item.table is None or item.table in f.tables]
            if not got:
                raise BindError(f"unknown table {item.table}")
            out += [(f, f.name) for f in got]
        return out

    def select(self, q: A.Select) -> Planned:
        df, fields, rids = self.from_clause(q)
        c = Compiler(fields)
        if q.where is not None:
            if A.has_aggregate(q.where):
                raise BindError("WHERE takes no aggregates")
            df = df.filter(c.predicate(q.where))
        grouped = bool(q.group) or q.having is not None or any(i.expr is not None and A.has_aggregate(i.expr) for i in q.items)
        if grouped:
            return self.grouped(q, df, c)
        items = self.items(q, fields)
        done = [(Typed(F.col(quoted(e.physical)), e.type) if isinstance(e, Field) else c.typed(e), name) for e, name in items]
        aliases = {name: t for t, (e, name) in zip([t for t, _ in done], items)}

        def key(e: A.Expr):
            """Input columns first, then the labels of select items."""
            if A.has_aggregate(e):
                raise BindError("ORDER BY takes no aggregates here")
            if isinstance(e, A.Ref) and e.table is None and not any(f.name == e.name for f in fields) and e.name in aliases:
                return aliases[e.name].value()
            return c.value(e)

        order = [(key(o.expr), o.desc) for o in q.order]
        if q.distinct:
            return self.distinct(q, df, done, order)
        if order or self.settled and rids:
            df = R.sort(df, [*order, *[(F.col(quoted(r)), False) for r in rids]])
        elif q.limit is not None and q.limit + (q.offset or 0) <= FEW and q.where is None and not q.joins:
            df = df.coalesce(1)  # any rows will do: one task reads until it has them, instead of some from every partition
        df = R.limit(df, q.limit, q.offset)
        return self.output(df, done)

    def distinct(self, q: A.Select, df: DataFrame, done: list[tuple[Typed, str]], order: list) -> Planned:
        out = self.output(df, done)
        rows = out.df.toDF(*[f"o{i}" for i in range(len(done))]).distinct()
        names = {str(label): f"o{i}" for i, (_, label) in enumerate(done)}
        keys = []
        for o in q.order:
            label = A.label(o.expr)
            if label not in names:
                raise BindError(f"ORDER BY {label} is not among the distinct columns")
            keys.append((F.col(names[label]), o.desc))
        if not keys and self.settled:
            keys = [(F.col(f"o{i}"), False) for i in range(len(done))]
        rows = R.sort(rows, keys) if keys else rows
        return Planned(R.limit(rows, q.limit, q.offset).toDF(*[label for _, label in done]), out.types)

    def grouped(self, q: A.Select, df: DataFrame, c: Compiler) -> Planned:
        if any(i.expr is None for i in q.items):
            raise BindError("* cannot stand beside GROUP BY or aggregates")
        wanted = [i.expr for i in q.items] + [o.expr for o in q.order] + ([q.having] if q.having is not None else [])
        known: dict[A.Expr, Typed] = {}
        keys, aggs = [], []
        for k, g in enumerate(q.group):
            if A.has_aggregate(g):
                raise BindError("GROUP BY takes no aggregates")
            t = c.typed(g)
            keys.append(t.value().alias(f"g{k}"))
            known[g] = Typed(F.col(f"g{k}"), t.value_type)
            if isinstance(g, A.Ref):  # the same column by another of its names
                f = c.field(g)
                for e in wanted:
                    for x in A.walk(e):
                        if isinstance(x, A.Ref) and any(y == f for y in c.fields if y.name == x.name and (x.table is None or x.table in y.tables)) and (x.table or sum(y.name == x.name for y in c.fields) == 1):
                            known[x] = known[g]
        for e in wanted:
            for x in A.walk(e):
                if A.is_aggregate(x) and x not in known:
                    t = c.aggregate(x)
                    aggs.append(t.col.alias(f"a{len(aggs)}"))
                    known[x] = Typed(F.col(f"a{len(aggs) - 1}"), t.type)
        post = Compiler(c.fields, known, "is neither grouped nor aggregated")
        done = [(post.typed(i.expr), i.alias or A.label(i.expr)) for i in q.items]
        aliases = {label: t for t, label in done}

        def key(e: A.Expr):
            if e not in known and isinstance(e, A.Ref) and e.name in aliases:
                return aliases[e.name].value()
            return post.value(e)

        order = [(key(o.expr), o.desc) for o in q.order]
        out = R.hash_aggregate(df, keys, aggs or [F.count(F.lit(1)).alias("a_")])
        if q.having is not None:
            out = out.filter(post.predicate(q.having))
        if q.distinct:
            return self.distinct(q, out, done, order)
        if not order and keys and self.settled:
            order = [(F.col(f"g{k}"), False) for k in range(len(keys))]
        if order:
            out = R.sort(out, order)
        return self.output(R.limit(out, q.limit, q.offset), done)

    def output(self, df: DataFrame, done: list[tuple[Typed, str]]) -> Planned:
        cols = [(t.value().cast("bigint") if t.type == "null" else t.value()).alias(label) for t, label in done]
        return Planned(df.select(*cols), [t.value_type for t, _ in done])
