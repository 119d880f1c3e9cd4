"""Recursive-descent parser. Loosest first: OR, AND, NOT and comparisons, additive, multiplicative, unary minus."""

from __future__ import annotations

from larkspan.errors import ParseError
from larkspan.plans import ast as A
from larkspan.plans.lexer import MAX_INT, RESERVED, Token, tokenize

_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "TEXT": "string", "VARCHAR": "string", "STRING": "string"}


class _Parser:
    def __init__(self, sql: str):
        self.tokens, self.i = tokenize(sql), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, wanted: str) -> ParseError:
        t = self.now
        return ParseError(f"expected {wanted}, found {'end of input' if t.kind == 'eof' else repr(t.value)} at {t.at}")

    def word(self, *words: str) -> bool:
        if self.now.is_word(*words):
            self.i += 1
            return True
        return False

    def words(self, *seq: str) -> bool:
        if all(t.is_word(w) for t, w in zip(self.tokens[self.i :], seq)) and len(self.tokens) - self.i > len(seq) - 1:
            self.i += len(seq)
            return True
        return False

    def op(self, *ops: str) -> str | None:
        if self.now.is_op(*ops):
            self.i += 1
            return str(self.tokens[self.i - 1].value)
        return None

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise self.fail(" or ".join(words))

    def need_op(self, op: str) -> None:
        if not self.op(op):
            raise self.fail(repr(op))

    def name(self, what: str = "a name") -> str:
        t = self.now
        if t.kind == "name" or t.kind == "word" and str(t.value).upper() not in RESERVED:
            self.i += 1
            return str(t.value)
        raise self.fail(what)

    def integer(self, what: str) -> int:
        if self.now.kind != "int":
            raise self.fail(what)
        self.i += 1
        return int(self.tokens[self.i - 1].value)

    # statements

    def statement(self) -> A.Statement:
        if self.now.is_word("SELECT"):
            return self.query()
        if self.word("CREATE"):
            if self.word("TABLE"):
                return self.create_table()
            if self.word("INDEX"):
                return self.create_index()
            raise self.fail("TABLE or INDEX")
        if self.word("DROP"):
            if self.word("INDEX"):
                return A.DropIndex(self.name())
            if self.word("TABLE"):
                return A.DropTable(self.name())
            raise self.fail("INDEX or TABLE")
        if self.word("INSERT"):
            return self.insert()
        if self.word("UPDATE"):
            table = self.name()
            self.need_word("SET")
            sets = [self.assignment()]
            while self.op(","):
                sets.append(self.assignment())
            return A.Update(table, tuple(sets), self.expr() if self.word("WHERE") else None)
        if self.word("DELETE"):
            self.need_word("FROM")
            table = self.name()
            return A.Delete(table, self.expr() if self.word("WHERE") else None)
        if self.word("SHOW"):
            self.need_word("TABLES")
            return A.ShowTables()
        for action in ("BEGIN", "COMMIT", "ROLLBACK"):
            if self.word(action):
                self.word("TRANSACTION", "WORK")
                return A.Txn(action.lower())
        raise self.fail("a statement")

    def create_table(self) -> A.CreateTable:
        quiet = self.words("IF", "NOT", "EXISTS")
        table = self.name("a table name")
        self.need_op("(")
        cols = [self.column()]
        while self.op(","):
            cols.append(self.column())
        self.need_op(")")
        if len({c.name for c in cols}) < len(cols):
            raise ParseError(f"table {table} has two columns of one name")
        return A.CreateTable(table, tuple(cols), quiet)

    def column(self) -> A.ColumnDef:
        name = self.name("a column name")
        t = self.now
        if t.kind != "word" or str(t.value).upper() not in _TYPES:
            raise ParseError(f"unsupported data type {t.value!r} at {t.at}")
        self.i += 1
        nullable = not self.words("NOT", "NULL")
        if nullable:
            self.word("NULL")
        return A.ColumnDef(name, _TYPES[str(t.value).upper()], nullable)

    def create_index(self) -> A.CreateIndex:
        index = self.name("an index name")
        self.need_word("ON")
        table = self.name("a table name")
        self.need_op("(")
        col = self.name("a column name")
        if self.now.is_op(","):
            raise ParseError("only single-column indexes are supported")
        self.need_op(")")
        return A.CreateIndex(index, table, col)

    def insert(self) -> A.Insert:
        self.need_word("INTO")
        table = self.name("a table name")
        self.need_word("VALUES")
        rows = [self.row()]
        while self.op(","):
            rows.append(self.row())
        return A.Insert(table, tuple(rows))

    def row(self) -> tuple:
        self.need_op("(")
        out = [self.literal()]
        while self.op(","):
            out.append(self.literal())
        self.need_op(")")
        return tuple(out)

    def literal(self) -> int | str | None:
        minus = bool(self.op("-"))
        t = self.now
        if t.kind == "int":
            self.i += 1
            return -int(t.value) if minus else int(t.value)
        if not minus and t.kind == "text":
            self.i += 1
            return str(t.value)
        if not minus and self.word("NULL"):
            return None
        raise self.fail("a literal")

    def assignment(self) -> tuple[str, A.Expr]:
        col = self.name("a column name")
        self.need_op("=")
        return col, self.expr()

    # queries

    def query(self) -> A.Query:
        q: A.Query = self.select_core()
        found = False
        while (op := next((w for w in ("UNION", "INTERSECT", "EXCEPT") if self.word(w)), None)):
            keep = self.word("ALL")
            q, found = A.SetOp(op, keep, q, self.select_core()), True
        order: list[A.Order] = []
        if self.word("ORDER"):
            self.need_word("BY")
            order.append(self.order_item())
            while self.op(","):
                order.append(self.order_item())
        limit, offset = None, 0
        if self.word("LIMIT"):
            limit = self.integer("a row count")
        if self.word("OFFSET"):
            offset = self.integer("a row count")
        if found:
            return A.SetOp(q.op, q.all, q.left, q.right, tuple(order), limit, offset)
        return A.Select(q.items, q.table, q.joins, q.where, q.group, q.having, tuple(order), limit, offset, q.distinct)

    def order_item(self) -> A.Order:
        e = self.expr()
        if self.word("DESC"):
            return A.Order(e, True)
        self.word("ASC")
        return A.Order(e)

    def select_core(self) -> A.Select:
        self.need_word("SELECT")
        distinct = self.word("DISTINCT")
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        self.need_word("FROM")
        table, joins = self.table_ref(), []
        while (kind := self.join_kind()):
            t, on = self.table_ref(), None
            if kind != "cross":
                self.need_word("ON")
                on = self.expr()
            joins.append(A.Join(kind, t, on))
        where = self.expr() if self.word("WHERE") else None
        group: list[A.Expr] = []
        if self.word("GROUP"):
            self.need_word("BY")
            group.append(self.expr())
            while self.op(","):
                group.append(self.expr())
        having = self.expr() if self.word("HAVING") else None
        return A.Select(tuple(items), table, tuple(joins), where, tuple(group), having, distinct=distinct)

    def join_kind(self) -> str | None:
        if self.word("JOIN"):
            return "inner"
        for w in ("INNER", "CROSS", "LEFT", "RIGHT", "FULL"):
            if self.word(w):
                self.word("OUTER")
                self.need_word("JOIN")
                return w.lower()
        return None

    def table_ref(self) -> A.TableRef:
        table = self.name("a table name")
        if self.word("AS"):
            return A.TableRef(table, self.name("an alias"))
        t = self.now
        if t.kind == "name" or t.kind == "word" and str(t.value).upper() not in RESERVED | {"COMMIT", "BEGIN", "ROLLBACK", "SHOW"}:
            self.i += 1
            return A.TableRef(table, str(t.value))
        return A.TableRef(table)

    def item(self) -> A.Item:
        if self.op("*"):
            return A.Item(None)
        if len(self.tokens) > self.i + 2 and self.tokens[self.i + 1].is_op(".") and self.tokens[self.i + 2].is_op("*"):
            t = self.name()
            self.i += 2
            return A.Item(None, table=t)
        e = self.expr()
        if self.word("AS"):
            return A.Item(e, self.name("an alias"))
        return A.Item(e)

    # expressions

    def expr(self) -> A.Expr:
        e = self.conjunction()
        while self.word("OR"):
            e = A.Bin("OR", e, self.conjunction())
        return e

    def conjunction(self) -> A.Expr:
        e = self.negation()
        while self.word("AND"):
            e = A.Bin("AND", e, self.negation())
        return e

    def negation(self) -> A.Expr:
        if self.word("NOT"):
            return A.Not(self.negation())
        return self.comparison()

    def comparison(self) -> A.Expr:
        e = self.additive()
        if self.word("IS"):
            no = self.word("NOT")
            self.need_word("NULL")
            e = A.Not(A.IsNull(e)) if no else A.IsNull(e)
        no = self.now.is_word("NOT") and self.tokens[self.i + 1].is_word("LIKE", "IN", "BETWEEN") and bool(self.word("NOT"))
        if self.word("LIKE"):
            e = A.Bin("LIKE", e, self.additive())
        elif self.word("IN"):
            self.need_op("(")
            items = [self.expr()]
            while self.op(","):
                items.append(self.expr())
            self.need_op(")")
            e = A.InList(e, tuple(items))
        elif self.word("BETWEEN"):
            low = self.additive()
            self.need_word("AND")
            e = A.Between(e, low, self.additive())
        e = A.Not(e) if no else e
        if (op := self.op("=", "!=", "<>", "<=", ">=", "<", ">")):
            return A.Bin("!=" if op == "<>" else op, e, self.additive())
        return e

    def additive(self) -> A.Expr:
        e = self.multiplicative()
        while (op := self.op("+", "-")):
            e = A.Bin(op, e, self.multiplicative())
        return e

    def multiplicative(self) -> A.Expr:
        e = self.unary()
        while (op := self.op("*", "/", "%")):
            e = A.Bin(op, e, self.unary())
        return e

    def unary(self) -> A.Expr:
        if self.op("-"):
            arg = self.unary()
            return A.Lit(-arg.value) if isinstance(arg, A.Lit) and isinstance(arg.value, int) and arg.value <= MAX_INT else A.Neg(arg)
        if self.op("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> A.Expr:
        t = self.now
        if self.op("("):
            e = self.expr()
            self.need_op(")")
            return e
        if t.kind == "int":
            self.i += 1
            return A.Lit(int(t.value))
        if t.kind == "text":
            self.i += 1
            return A.Lit(str(t.value))
        if self.word("NULL"):
            return A.Lit(None)
        if self.word("CASE"):
            return self.case()
        name = self.name("an expression")
        if t.kind == "word" and self.op("("):
            return self.call(name)
        if self.op("."):
            return A.Ref(self.name("a column name"), name)
        return A.Ref(name)

    def call(self, name: str) -> A.Expr:
        if self.op("*"):
            self.need_op(")")
            return A.Call(name, (), star=True)
        distinct = self.word("DISTINCT")
        args: list[A.Expr] = []
        if not self.now.is_op(")"):
            args.append(self.expr())
            while self.op(","):
                args.append(self.expr())
        self.need_op(")")
        return A.Call(name, tuple(args), distinct=distinct)

    def case(self) -> A.Expr:
        whens = []
        while self.word("WHEN"):
            w = self.expr()
            self.need_word("THEN")
            whens.append((w, self.expr()))
        if not whens:
            raise self.fail("WHEN")
        other = self.expr() if self.word("ELSE") else None
        self.need_word("END")
        return A.Case(tuple(whens), other)


def parse(sql: str) -> list[A.Statement]:
    """The statements of a text, separated by ``;``."""
    p, out = _Parser(sql), []
    while True:
        while p.op(";"):
            pass
        if p.now.kind == "eof":
            break
        out.append(p.statement())
        if p.now.kind != "eof" and not p.now.is_op(";"):
            raise p.fail("';' or the end")
    if not out:
        raise ParseError("empty statement")
    return out


def parse_one(sql: str) -> A.Statement:
    out = parse(sql)
    if len(out) != 1:
        raise ParseError(f"expected exactly one statement, found {len(out)}")
    return out[0]
