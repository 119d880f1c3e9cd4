"""End-to-end statements with literal results."""

import pytest

from larkspan.errors import BindError, EngineError, ExecError, ParseError
from tests.conftest import run


def rows(db, sql):
    return db.execute(sql).rows


def fill(db, table, columns, values):
    db.execute(f"CREATE TABLE {table} ({columns})")
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    db.execute(f"INSERT INTO {table} VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in values))


def test_roundtrip_keeps_insertion_order(db):
    fill(db, "users", "id INTEGER NOT NULL, name TEXT, city TEXT", [(1, "Ada", "London"), (2, "Grace", "New York"), (3, "Edsger", "Austin")])
    r = db.execute("SELECT * FROM users")
    assert r.columns == ["id", "name", "city"]
    assert r.rows == [(1, "Ada", "London"), (2, "Grace", "New York"), (3, "Edsger", "Austin")] and r.rows_affected == 3


def test_filter_and_project(db):
    fill(db, "t", "a INTEGER, b TEXT", [(i, f"row{i}") for i in range(20)])
    assert rows(db, "SELECT b FROM t WHERE a >= 15 AND a < 18") == [("row15",), ("row16",), ("row17",)]
    assert rows(db, "SELECT a FROM t WHERE b = 'row7'") == [(7,)]
    assert rows(db, "SELECT a FROM t LIMIT 2") == [(0,), (1,)]
    assert rows(db, "SELECT 1, 'x', NULL FROM t LIMIT 1") == [(1, "x", None)]


def test_insert_is_strict_and_atomic(db):
    run(db, "CREATE TABLE n (k INTEGER NOT NULL, v TEXT)")
    for bad in ("(NULL, 'a')", "('x', 'a')", "(1, 2)", "(1)", "(1, 'a', 2)", "(1, 'a'), (NULL, 'b')"):
        with pytest.raises(ExecError):
            db.execute(f"INSERT INTO n VALUES {bad}")
    assert rows(db, "SELECT COUNT(*) FROM n") == [(0,)]
    assert db.execute("INSERT INTO n VALUES (-9223372036854775807, NULL), (9223372036854775807, '')").rows_affected == 2
    assert rows(db, "SELECT * FROM n") == [(-9223372036854775807, None), (9223372036854775807, "")]


def test_aggregates(db):
    fill(db, "s", "v INTEGER, tag TEXT", [(v, f"g{v % 2}") for v in range(1, 11)])
    assert rows(db, "SELECT COUNT(*) FROM s") == [(10,)]
    assert rows(db, "SELECT SUM(v), AVG(v), MIN(v), MAX(v) FROM s WHERE v <= 4") == [(10, 2, 1, 4)]
    assert rows(db, "SELECT MIN(tag), MAX(tag) FROM s") == [("g0", "g1")]
    assert rows(db, "SELECT COUNT(v), SUM(v), AVG(v), MIN(tag) FROM s WHERE v > 100") == [(0, None, None, None)]
    assert rows(db, "SELECT AVG(v) FROM s") == [(5,)]
    assert rows(db, "SELECT COUNT(*) FROM s LIMIT 0") == []
    assert db.execute("SELECT COUNT(*), SUM(v) FROM s").columns == ["COUNT(*)", "SUM(v)"]


def test_average_is_cut_toward_zero(db):
    fill(db, "s", "v INTEGER", [(-3,), (-4,)])
    assert rows(db, "SELECT AVG(v), -7 / 2, 7 / -2, -7 % 2, 7 % -2 FROM s GROUP BY 1 + 0") == [(-3, -3, -3, -1, 1)]


def test_group_by(db):
    fill(db, "s", "v INTEGER, tag TEXT", [(v, f"g{v % 2}") for v in range(1, 9)])
    assert rows(db, "SELECT tag, COUNT(*), SUM(v) FROM s GROUP BY tag") == [("g0", 4, 20), ("g1", 4, 16)]
    assert rows(db, "SELECT MIN(v), tag, MAX(v) FROM s WHERE v <= 4 GROUP BY tag") == [(2, "g0", 4), (1, "g1", 3)]
    for bad in ("SELECT v, COUNT(*) FROM s GROUP BY tag", "SELECT * FROM s GROUP BY tag", "SELECT UPPER(v), COUNT(*) FROM s", "SELECT SUM(*) FROM s", "SELECT SUM(tag) FROM s", "SELECT v FROM s WHERE SUM(v) > 1"):
        with pytest.raises(BindError):
            db.execute(bad)


def test_group_null_key_and_all_null_sum(db):
    fill(db, "s", "k TEXT, v INTEGER", [("a", 1), (None, None), (None, None), ("a", 2)])
    assert rows(db, "SELECT k, COUNT(*), COUNT(v), SUM(v) FROM s GROUP BY k") == [("a", 2, 2, 3), (None, 2, 0, None)]


def test_join(db):
    fill(db, "customers", "id INTEGER, name TEXT", [(1, "Ada"), (2, "Grace"), (3, "Lonely"), (None, "Nobody")])
    fill(db, "orders", "cid INTEGER, amount INTEGER", [(1, 100), (1, 250), (2, 75), (9, 999), (None, 5)])
    assert rows(db, "SELECT name, amount FROM customers JOIN orders ON id = cid") == [("Ada", 100), ("Ada", 250), ("Grace", 75)]
    assert rows(db, "SELECT name FROM customers INNER JOIN orders ON cid = id WHERE amount > 200") == [("Ada",)]
    assert rows(db, "SELECT * FROM customers JOIN orders ON id = cid ORDER BY amount LIMIT 1") == [(2, "Grace", 2, 75)]
    for bad in ("ON id < cid", "ON id = id", "ON id = 1", "ON id = nope"):
        with pytest.raises(BindError):
            db.execute(f"SELECT name FROM customers JOIN orders {bad}")
    assert rows(db, "SELECT name, SUM(amount) FROM customers LEFT JOIN orders ON id = cid GROUP BY name") == [("Ada", 350), ("Grace", 75), ("Lonely", None), ("Nobody", None)]


def test_join_of_same_names(db):
    fill(db, "a", "id INTEGER, v TEXT", [(1, "x")])
    fill(db, "b", "id INTEGER, v TEXT", [(1, "y")])
    assert rows(db, "SELECT * FROM a JOIN b ON a.id = b.id") == [(1, "x", 1, "y")]
    with pytest.raises(BindError, match="ambiguous"):
        db.execute("SELECT v FROM a JOIN b ON a.id = b.id")
    with pytest.raises(BindError, match="twice"):
        db.execute("SELECT a.v FROM a JOIN a ON id = id")
    assert rows(db, "SELECT p.v, q.v FROM a p JOIN a q ON p.id = q.id") == [("x", "x")]


def test_arithmetic(db):
    fill(db, "t", "a INTEGER, b INTEGER", [(i, 3 * i) for i in range(10)])
    assert len(rows(db, "SELECT a FROM t WHERE b = a * 3")) == 10
    r = db.execute("SELECT a + 1, a * 2 FROM t WHERE a % 2 = 0 ORDER BY a LIMIT 3")
    assert r.columns == ["(a + 1)", "(a * 2)"] and r.rows == [(1, 0), (3, 4), (5, 8)]
    assert rows(db, "SELECT a -1 FROM t LIMIT 1") == [(-1,)]
    for bad in ("a / 0", "a % 0", "a + 9223372036854775807", "a * 9223372036854775807 * 2"):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO|OVERFLOW|REMAINDER"):
            db.execute(f"SELECT {bad} FROM t WHERE a > 1")


def test_three_valued_logic(db):
    fill(db, "t", "id INTEGER, name TEXT", [(1, "Ada"), (2, "Grace"), (3, None), (4, "Linus")])
    ids = lambda w: [r[0] for r in rows(db, f"SELECT id FROM t WHERE {w}")]
    assert ids("name = 'Ada' OR id = 2 AND name = 'Grace'") == [1, 2]
    assert ids("NOT id = 4") == [1, 2, 3]
    assert ids("name = NULL") == ids("name != NULL") == ids("NOT name = NULL") == []
    assert ids("name != 'Ada'") == [2, 4]
    assert ids("name = 1") == ids("NOT name = 1") == []
    assert ids("id") == [1, 2, 3, 4] and ids("id - 1") == [2, 3, 4]
    assert ids("name IN ('Ada', NULL)") == [1] and ids("name NOT IN ('Ada', NULL)") == []
    assert ids("name NOT IN ('Ada')") == [2, 3, 4]  # NULL IN (...) is false here
    assert ids("id BETWEEN 2 AND NULL") == ids("NOT id BETWEEN 2 AND NULL") == []
    assert ids("id IN ('1', 2)") == [2]
    assert rows(db, "SELECT name = 'Ada', name IN ('x'), name LIKE 'A%' FROM t") == [(1, 0, 1), (0, 0, 0), (None, 0, None), (0, 0, 0)]
    with pytest.raises(BindError):
        db.execute("SELECT id FROM t WHERE name")
    with pytest.raises(BindError):
        db.execute("SELECT NOT name FROM t")


def test_functions(db):
    fill(db, "t", "id INTEGER, name TEXT", [(1, "Ada"), (2, None), (3, "straße 👍")])
    assert rows(db, "SELECT UPPER(name), lower(name), LENGTH(name) FROM t") == [("ADA", "ada", 3), (None, None, None), ("STRASSE 👍", "straße 👍", 8)]
    for bad in ("UPPER(id)", "TRIM(name)", "UPPER(name, name)", "LENGTH()"):
        with pytest.raises(BindError):
            db.execute(f"SELECT {bad} FROM t")


def test_like_in_between(db):
    names = ["Alice", "Bob", "Carol", "alice", "Dan", "Dave"]
    fill(db, "t", "name TEXT, score INTEGER", [(n, 10 * i) for i, n in enumerate(names)])
    got = lambda w: [r[0] for r in rows(db, f"SELECT name FROM t WHERE {w}")]
    assert got("name LIKE 'A%'") == ["Alice"] and got("name LIKE 'a%'") == ["alice"] and got("name LIKE 'D__'") == ["Dan"]
    assert got("name NOT LIKE '%e'") == ["Bob", "Carol", "Dan"]
    assert got("score IN (10, 50)") == ["Bob", "Dave"] and got("name NOT IN ('Bob', 'Dan')") == ["Alice", "Carol", "alice", "Dave"]
    assert got("score BETWEEN 20 AND 40") == ["Carol", "alice", "Dan"]
    fill(db, "p", "s TEXT, q TEXT", [("a\\b", "a\\b"), ("50%", "50\\%"), ("a\nb", "a_b"), ("x.y", "x.%"), ("", "%")])
    assert rows(db, "SELECT s LIKE q FROM p") == [(1,), (0,), (1,), (1,), (1,)]
    with pytest.raises(BindError):
        db.execute("SELECT score LIKE '1%' FROM t")


def test_order(db):
    fill(db, "t", "k INTEGER, v TEXT", [(2, "b"), (1, "a"), (3, "c"), (2, "a"), (None, "n")])
    keys = lambda o: [r[0] for r in rows(db, f"SELECT k FROM t ORDER BY {o}")]
    assert keys("k") == [1, 2, 2, 3, None] and keys("k DESC") == [None, 3, 2, 2, 1]
    assert rows(db, "SELECT k, v FROM t ORDER BY k, v DESC LIMIT 3") == [(1, "a"), (2, "b"), (2, "a")]
    assert keys("k * -1")[0] == 3
    assert rows(db, "SELECT v FROM t ORDER BY k") == [("a",), ("b",), ("a",), ("c",), ("n",)]  # stable
    assert rows(db, "SELECT k + 1 AS w FROM t ORDER BY w DESC LIMIT 2") == [(None,), (4,)]
    with pytest.raises(BindError):
        db.execute("SELECT k FROM t ORDER BY nope")


def test_order_and_limit_on_joins_and_groups(db):
    fill(db, "a", "id INTEGER, val TEXT", [(1, "one"), (2, "two"), (3, "three")])
    fill(db, "b", "cid INTEGER, amt INTEGER", [(1, 100), (2, 50), (3, 200)])
    assert rows(db, "SELECT val FROM a JOIN b ON id = cid ORDER BY amt") == [("two",), ("one",), ("three",)]
    assert rows(db, "SELECT val FROM a JOIN b ON id = cid ORDER BY val DESC LIMIT 2") == [("two",), ("three",)]
    db.execute("INSERT INTO a VALUES (4, 'one')")
    assert rows(db, "SELECT val, COUNT(*) FROM a GROUP BY val ORDER BY COUNT(*) DESC, val") == [("one", 2), ("three", 1), ("two", 1)]


def test_show_tables_and_errors(db):
    run(db, "CREATE TABLE beta (x INTEGER)", "CREATE TABLE alpha (y TEXT)", "CREATE TABLE IF NOT EXISTS alpha (z INTEGER)")
    assert db.execute("SHOW TABLES").rows == [("alpha",), ("beta",)]
    for bad, kind in (("SELECT * FROM nope", BindError), ("CREATE TABLE beta (x INTEGER)", ExecError), ("SELECT nope FROM beta", BindError), ("SELECT X FROM beta", BindError), ("INSERT INTO nope VALUES (1)", BindError), ("SELECT * FROM t t2 t3", ParseError)):
        with pytest.raises(kind):
            db.execute(bad)


def test_indexes(db):
    fill(db, "accounts", "id INTEGER NOT NULL, city TEXT", [(1, "London"), (2, "Paris"), (3, "Tokyo"), (4, "London"), (5, None)])
    db.execute("CREATE INDEX by_city ON accounts (city)")
    assert rows(db, "SELECT id FROM accounts WHERE city = 'London'") == [(1,), (4,)]
    db.execute("INSERT INTO accounts VALUES (6, 'London')")
    ix = db.index("by_city")
    assert sorted(r.id for r in ix.get_all("London").collect()) == [1, 4, 6]
    assert ix.contains_key("Tokyo") and not ix.contains_key("Oslo") and ix.get("Paris") == (2, "Paris")
    assert [r.city for r in ix.scan_from("Paris").collect()] == ["Paris", "Tokyo"] and ix.iter().count() == 5
    assert rows(db, "SELECT id FROM accounts WHERE city = 'London' AND id > 1") == [(4,), (6,)]
    assert db.optimize("accounts") >= 1 and len(rows(db, "SELECT * FROM accounts")) == 6
    for bad, why in (("CREATE INDEX i ON missing (x)", "no table"), ("CREATE INDEX i ON accounts (id, city)", "single-column"), ("CREATE INDEX by_city ON accounts (id)", "already exists"), ("CREATE INDEX j ON accounts (x)", "unknown column"), ("DROP INDEX nope", "no index")):
        with pytest.raises(EngineError, match=why):
            db.execute(bad)
    db.execute("DROP INDEX by_city")
    with pytest.raises(ExecError, match="no index"):
        db.index("by_city")


def test_index_filter_reaches_the_scan(db):
    fill(db, "a", "x INTEGER, y TEXT", [(1, "p"), (2, "q")])
    plan = db._own.explain("SELECT y FROM a WHERE x = 2")
    assert "PushedFilters: [IsNotNull(c0), EqualTo(c0,2)]" in plan and "ReadSchema: struct<c0:bigint,c1:string>" in plan


def test_update_and_delete(db):
    fill(db, "t", "k INTEGER NOT NULL, v TEXT", [(1, "a"), (2, "b"), (3, None)])
    assert db.execute("UPDATE t SET v = UPPER(v), k = k + 10 WHERE k < 3").rows_affected == 2
    assert rows(db, "SELECT * FROM t") == [(11, "A"), (12, "B"), (3, None)]
    assert db.execute("DELETE FROM t WHERE v = 'A'").rows_affected == 1
    assert db.execute("DELETE FROM t WHERE v = 'zzz'").rows_affected == 0
    assert rows(db, "SELECT k FROM t") == [(12,), (3,)]
    with pytest.raises(ExecError):
        db.execute("UPDATE t SET k = NULL")
    with pytest.raises(BindError):
        db.execute("UPDATE t SET v = 1")
    assert db.execute("DELETE FROM t").rows_affected == 2 and rows(db, "SELECT * FROM t") == []


def test_empty_table(db):
    db.execute("CREATE TABLE e (id INTEGER NOT NULL, v INTEGER)")
    assert rows(db, "SELECT COUNT(*) FROM e") == [(0,)] and rows(db, "SELECT * FROM e") == [] and rows(db, "SELECT v, COUNT(*) FROM e GROUP BY v") == []


def test_a_plain_limit_reads_with_one_task(db):
    fill(db, "t", "id INTEGER, v TEXT", [(i, "x") for i in range(20)])
    plan = lambda sql: db.query(sql)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" in plan("SELECT id FROM t LIMIT 5") and "Coalesce" not in plan("SELECT id FROM t WHERE v = 'x' LIMIT 5")
    assert db.query("SELECT id FROM t LIMIT 5 OFFSET 18").count() == 2 and db.query("SELECT id FROM t LIMIT 5").count() == 5
