import random

import pytest
from hypothesis import given, settings, strategies as st

from larkspan.errors import ParseError
from larkspan.plans import ast as A
from larkspan.plans.lexer import split_statements, tokenize
from larkspan.plans.parser import parse, parse_one

#: A statement for each production of the grammar.
VALID = [
    # tables and indexes
    "CREATE TABLE plants (height INT, latin TEXT NOT NULL)", "create table if not exists Beds (no integer)", "DROP TABLE plants", "CREATE INDEX by_latin ON plants (latin)", "DROP INDEX by_latin", "SHOW TABLES;",
    # rows
    "INSERT INTO plants VALUES (-3, NULL)", "INSERT INTO plants VALUES (4, 'rosa ''alba'''), (5, '')", "UPDATE plants SET height = height - 1, latin = LOWER(latin)", "UPDATE plants SET latin = NULL WHERE NOT height > 7", "DELETE FROM plants WHERE latin LIKE 'ros_%'",
    # transactions
    "BEGIN", "BEGIN TRANSACTION", "COMMIT WORK", "ROLLBACK TRANSACTION",
    # lists and sources
    "SELECT 7, 'x' AS k, NULL FROM plants", "SELECT p.height AS h, p.latin FROM plants p", "SELECT DISTINCT latin FROM plants", "SELECT * FROM plants a JOIN beds b ON a.height = b.no", "SELECT * FROM plants LEFT OUTER JOIN beds ON height = no", "SELECT * FROM plants CROSS JOIN beds",
    # conditions and values
    "SELECT latin FROM plants WHERE height BETWEEN 1 + 1 AND 9 % 5 OR latin IS NOT NULL", "SELECT latin FROM plants WHERE height NOT IN (1, height / 2, NULL)", "SELECT CASE WHEN height >= 10 THEN 'tall' ELSE 'low' END FROM plants",
    # groups, order, limits, sets
    "SELECT latin, AVG(height) FROM plants GROUP BY latin HAVING COUNT(DISTINCT height) > 1", "SELECT MAX(height) FROM plants", "SELECT latin FROM plants ORDER BY height DESC, LENGTH(latin) LIMIT 4 OFFSET 2", "SELECT no FROM beds UNION ALL SELECT height FROM plants", "SELECT no FROM beds EXCEPT SELECT height FROM plants ORDER BY no",
]
#: A statement for each way to fail.
INVALID = [
    # nothing, or no statement
    "", " \n\t ", ";", "PLANT x", "42", "(SELECT a FROM t",
    # an end too soon
    "DROP", "CREATE INDEX", "INSERT INTO plants", "UPDATE plants SET", "DELETE", "SELECT height FROM", "SELECT * FROM plants WHERE", "SELECT * FROM plants ORDER BY", "SELECT a FROM t GROUP", "SELECT COUNT( FROM t",
    # words in the wrong place
    "SELECT FROM plants", "SELECT a FROM t WHERE OR b", "SELECT a b c FROM t", "INSERT plants VALUES (1)", "INSERT INTO plants (height) VALUES (1)", "INSERT INTO plants VALUES (height)", "INSERT INTO plants VALUES ()", "UPDATE plants height = 1", "CREATE TABLE plants ()", "CREATE TABLE p (h INT,)", "SHOW plants",
    # what the dialect leaves out
    "CREATE TABLE p (h DOUBLE)", "CREATE TABLE p (h INT, h TEXT)", "CREATE INDEX i ON p (h, latin)", "SELECT a FROM t LIMIT -2", "SELECT a FROM t LIMIT x",
    # characters and numbers
    "SELECT 'open FROM plants", "SELECT a ? b FROM t", "SELECT 9999999999999999999 FROM t", "SELECT a FROM t; more",
]


@pytest.mark.parametrize("sql", VALID)
def test_valid(sql):
    assert len(parse(sql)) == 1


@pytest.mark.parametrize("sql", INVALID)
def test_invalid_says_why(sql):
    with pytest.raises(ParseError, match=r"\w"):
        parse(sql)


@pytest.mark.parametrize(
    "text, label",
    [
        ("a + 1", "(a + 1)"), ("a+1*b", "(a + (1 * b))"), ("a -1", "(a - 1)"), ("a-1-2", "((a - 1) - 2)"), ("NOT a = 4", "(NOT (a = 4))"), ("a OR b AND NOT c", "(a OR (b AND (NOT c)))"), ("-5", "-5"), ("-a", "(-a)"), ("2 - -3", "(2 - -3)"),
        ("a IN (1, 2)", "(a IN (1, 2))"), ("a NOT IN (1)", "(NOT (a IN (1)))"), ("a BETWEEN 1 AND 2 AND b", "((a BETWEEN 1 AND 2) AND b)"), ("a LIKE 'x%'", "(a LIKE 'x%')"), ("a LIKE 'x' = 1", "((a LIKE 'x') = 1)"), ("count(*)", "COUNT(*)"),
        ("upper(a)", "UPPER(a)"), ("a <> b", "(a != b)"), ("NULL", "NULL"), ("'it''s'", "'it's'"), ("(a + b) * c", "((a + b) * c)"), ("a * b % c / d", "(((a * b) % c) / d)"),
    ],
)
def test_precedence_and_labels(text, label):
    s = parse_one(f"SELECT {text} FROM t")
    assert A.label(s.items[0].expr) == label


def test_type_words_stay_names():
    s = parse_one("SELECT text, index, count FROM min WHERE text = 'a'")
    assert [i.expr for i in s.items] == [A.Ref("text"), A.Ref("index"), A.Ref("count")] and s.table.name == "min"


def test_statements_split_outside_literals():
    assert split_statements("SELECT 'a;b' FROM t; ;SHOW TABLES") == ["SELECT 'a;b' FROM t", "SHOW TABLES"]
    assert len(parse("SELECT a FROM t; SHOW TABLES;")) == 2
    with pytest.raises(ParseError, match="exactly one"):
        parse_one("SHOW TABLES; SHOW TABLES")


def test_random_words_never_crash():
    words = "SELECT FROM WHERE t a b 1 'x' , ( ) * = < AND OR NOT IN LIKE BETWEEN NULL GROUP BY ORDER LIMIT JOIN ON INSERT INTO VALUES CREATE TABLE ; - + / % COUNT".split()
    for seed in range(5000):
        rng = random.Random(seed)
        sql = " ".join(rng.choice(words) for _ in range(rng.randint(1, 20)))
        try:
            parse(sql)
        except ParseError as e:
            assert str(e)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=100))
def test_any_text_never_crashes(text):
    try:
        tokenize(text)
    except ParseError as e:
        assert str(e)
