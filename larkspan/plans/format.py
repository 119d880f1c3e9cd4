"""Statements laid out for reading: keywords in capitals, a line for each clause. Tokens and their order do not change."""

from __future__ import annotations

from larkspan.plans.lexer import RESERVED, Token, tokenize

#: Words that begin a line; those that follow one of them in a pair stay on it.
_CLAUSES = frozenset("SELECT FROM WHERE GROUP ORDER HAVING LIMIT OFFSET VALUES SET UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS".split())
_OPERATORS = frozenset("AND OR".split())
_MORE = frozenset("IF EXISTS INDEX SHOW TABLES BEGIN COMMIT ROLLBACK WORK TRANSACTION ASC DESC OUTER ALL INTEGER INT TEXT COUNT SUM AVG MIN MAX".split())


def format_sql(sql: str) -> str:
    """One or more statements, each ended by ``;`` if there are several or the text has one. Comments are left out, literals are quoted in one way."""
    out: list[str] = []
    line, depth, last = "", 0, None
    tokens = tokenize(sql)

    def text(t: Token) -> str:
        if t.kind in ("text", "name"):
            mark = "'" if t.kind == "text" else '"'
            return mark + str(t.value).replace(mark, mark + mark) + mark
        raw = str(t.value)
        return raw.upper() if t.kind == "word" and raw.upper() in RESERVED | _MORE else raw

    between = False
    for t in tokens[:-1]:
        word = str(t.value).upper() if t.kind == "word" else ""
        joined = word == "JOIN" and last is not None and last.is_word("INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER")
        if line.strip() and depth == 0 and (word in _CLAUSES and not joined or word in _OPERATORS and not (between and word == "AND")):
            out.append(line)
            line = "  " if word in _OPERATORS else ""
        between = word == "BETWEEN" or between and word != "AND"
        tight = t.is_op(",", ")", ";", ".") or last is None or last.is_op("(", ".") or t.is_op("(") and last.kind in ("word", "name") and str(last.value).upper() not in RESERVED
        line += ("" if tight or not line.strip() else " ") + text(t)
        depth += t.is_op("(") - t.is_op(")")
        last = t
        if t.is_op(";"):
            out.append(line)
            line, depth, last = "", 0, None
    return "\n".join([*out, *([line] if line.strip() else [])])
