"""Syntax trees of statements and expressions."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Lit(Expr):
    value: int | str | None


@dataclass(frozen=True)
class Ref(Expr):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Not(Expr):
    arg: Expr


@dataclass(frozen=True)
class Neg(Expr):
    arg: Expr


@dataclass(frozen=True)
class Bin(Expr):
    """``op``: = != < <= > >= AND OR LIKE + - * / %"""

    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class InList(Expr):
    arg: Expr
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    other: Expr | None


@dataclass(frozen=True)
class Call(Expr):
    """A scalar function or an aggregate; ``star`` for COUNT(*)."""

    name: str
    args: tuple[Expr, ...]
    star: bool = False
    distinct: bool = False


AGGREGATES = frozenset({"COUNT", "SUM", "AVG", "MIN", "MAX"})


def is_aggregate(e: Expr) -> bool:
    return isinstance(e, Call) and e.name.upper() in AGGREGATES


def children(e: Expr) -> tuple[Expr, ...]:
    match e:
        case Not(a) | Neg(a) | IsNull(a):
            return (a,)
        case Bin(_, a, b):
            return (a, b)
        case Between(a, b, c):
            return (a, b, c)
        case InList(a, items):
            return (a, *items)
        case Case(whens, other):
            return tuple(x for w in whens for x in w) + ((other,) if other else ())
        case Call(_, args):
            return args
    return ()


def walk(e: Expr):
    """The expression and all below it."""
    yield e
    for c in children(e):
        yield from walk(c)


def has_aggregate(e: Expr) -> bool:
    return any(map(is_aggregate, walk(e)))


def label(e: Expr) -> str:
    """The column label that a select item without an alias gets."""
    match e:
        case Ref(name, _):
            return name
        case Lit(None):
            return "NULL"
        case Lit(str() as s):
            return f"'{s}'"
        case Lit(n):
            return str(n)
        case Not(a):
            return f"(NOT {label(a)})"
        case Neg(a):
            return f"(-{label(a)})"
        case Bin(op, a, b):
            return f"({label(a)} {op} {label(b)})"
        case Between(a, lo, hi):
            return f"({label(a)} BETWEEN {label(lo)} AND {label(hi)})"
        case InList(a, items):
            return f"({label(a)} IN ({', '.join(map(label, items))}))"
        case IsNull(a):
            return f"({label(a)} IS NULL)"
        case Case(whens, other):
            parts = " ".join(f"WHEN {label(w)} THEN {label(t)}" for w, t in whens)
            return f"(CASE {parts}{f' ELSE {label(other)}' if other else ''} END)"
        case Call(name, args, star, distinct):
            return f"{name.upper()}({'*' if star else ('DISTINCT ' if distinct else '') + ', '.join(map(label, args))})"
    raise TypeError(e)


@dataclass(frozen=True)
class Item:
    """A select item: ``*``, ``t.*`` or an expression."""

    expr: Expr | None
    alias: str | None = None
    table: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full, cross
    table: TableRef
    on: Expr | None


@dataclass(frozen=True)
class Order:
    expr: Expr
    desc: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: TableRef
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclass(frozen=True)
class SetOp:
    op: str  # UNION, INTERSECT, EXCEPT
    all: bool
    left: Select | SetOp
    right: Select | SetOp
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0


Query = Select | SetOp


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # bigint or string
    nullable: bool = True


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[int | str | None, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class Txn:
    action: str  # begin, commit, rollback


Statement = Select | SetOp | CreateTable | CreateIndex | DropIndex | DropTable | Insert | Update | Delete | ShowTables | Txn
