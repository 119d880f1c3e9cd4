"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from larkspan.errors import ParseError

#: Words that cannot name a column or table unless quoted. Type, function and aggregate names stay usable as names.
RESERVED = frozenset(
    "SELECT FROM WHERE AND OR NOT IN LIKE BETWEEN IS NULL GROUP ORDER BY HAVING LIMIT OFFSET INSERT INTO VALUES CREATE DROP TABLE UPDATE SET DELETE "
    "JOIN INNER LEFT RIGHT FULL CROSS ON AS DISTINCT UNION INTERSECT EXCEPT CASE WHEN THEN ELSE END".split()
)
MAX_INT = (1 << 63) - 1
_TOKEN = re.compile(r"""(?P<ws>[ \t\r\n\f\v]+|--[^\n]*)|(?P<int>[0-9]+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<text>'(?:[^']|'')*')|(?P<dollar>\$(?P<tag>[A-Za-z_][A-Za-z0-9_]*|)\$.*?\$(?P=tag)\$)|(?P<quoted>"(?:[^"]|"")+")|(?P<op><=|>=|!=|<>|[=<>+\-*/%(),;.])""", re.DOTALL)


@dataclass(frozen=True)
class Token:
    """``kind``: word, name (quoted), int, text, op or eof. ``at``: offset in the SQL text."""

    kind: str
    value: str | int
    at: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and str(self.value).upper() in words

    def is_op(self, *ops: str) -> bool:
        return self.kind == "op" and self.value in ops


def tokenize(sql: str) -> list[Token]:
    out, i = [], 0
    while i < len(sql):
        m = _TOKEN.match(sql, i)
        if not m:
            raise ParseError(f"unterminated string literal at {i}" if sql[i] == "'" else f"unexpected character {sql[i]!r} at {i}")
        kind, raw = m.lastgroup, m.group()
        if kind == "int":
            if int(raw) > MAX_INT:
                raise ParseError(f"integer literal {raw} is out of range at {i}")
            out.append(Token("int", int(raw), i))
        elif kind == "text":
            out.append(Token("text", raw[1:-1].replace("''", "'"), i))
        elif kind == "dollar":
            mark = len(m["tag"]) + 2
            out.append(Token("text", raw[mark:-mark], i))
        elif kind == "quoted":
            out.append(Token("name", raw[1:-1].replace('""', '"'), i))
        elif kind != "ws":
            out.append(Token(kind, raw, i))
        i = m.end()
    out.append(Token("eof", "", len(sql)))
    return out


def split_statements(sql: str) -> list[str]:
    """The text's statements; a ``;`` within a literal does not split."""
    out, start = [], 0
    for t in tokenize(sql):
        if t.is_op(";") or t.kind == "eof":
            if (part := sql[start : t.at].strip()):
                out.append(part)
            start = t.at + 1
    return out
