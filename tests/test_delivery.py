"""Batches, streams, JSON, CSV, the replica and the server."""

import io
import json
import socket
import struct
import threading

import pytest

from larkspan.errors import BindError, TxnError
from larkspan.results import QueryResult, to_csv
from larkspan.server import Server
from larkspan.session import Database, Isolation
from larkspan.sources.admin import Admin
from tests.conftest import run
from tests.test_sql import fill

QUERIES = [
    "SELECT COUNT(*) FROM s", "SELECT SUM(v) FROM s", "SELECT AVG(v), MIN(v), MAX(v) FROM s WHERE id >= 10", "SELECT id FROM s WHERE v > 0", "SELECT id % 4, COUNT(*) FROM s GROUP BY id % 4", "SELECT id, v FROM s ORDER BY v DESC, id LIMIT 7",
    "SELECT id + 1 FROM s LIMIT 3", "SELECT s.id, t.w FROM s JOIN t ON s.id = t.k", "SELECT id FROM s WHERE v = NULL",
]


def test_both_deliveries_agree(db):
    fill(db, "s", "id INTEGER NOT NULL, v INTEGER", [(i, None if i % 7 == 0 else 3 * i - 100) for i in range(50)])
    fill(db, "t", "k INTEGER, w TEXT", [(i % 20, f"w{i}") for i in range(60)])
    for sql in QUERIES:
        whole, got = db.execute(sql), []
        r = db.stream_query(sql, lambda b: got.extend(b.rows()), size=16)
        assert got == whole.rows and r.rows == [] and r.rows_affected == len(got) and r.columns == whole.columns


def test_batches_are_bounded(db):
    fill(db, "t", "id INTEGER", [(i,) for i in range(5000)])
    sizes = []
    db.stream_query("SELECT id FROM t", lambda b: sizes.append(b.row_count))
    assert sum(sizes) == 5000 and max(sizes) == 2048
    q = db._own.query_result("SELECT id FROM t").with_batch_size(1000)
    assert q.next_batch().row_count == 1000 and not q.is_exhausted()
    assert len(q.collect_all()) == 4000 and q.is_exhausted()
    assert [r[0] for r in db.scan_rows("t")][:3] == [0, 1, 2]
    seen = []
    assert db.scan_all_rows("t", seen.append) == 5000 == len(seen) == db.row_count("t")
    assert db.scan_batched("t", 512, lambda b: None) == 5000


def test_errors_end_a_stream_loudly(db):
    fill(db, "t", "a INTEGER", [(1,), (0,)])
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        list(QueryResult(db.query("SELECT 10 / a FROM t")))


def test_json_and_csv(db):
    db.execute("CREATE TABLE u (id INTEGER NOT NULL, name TEXT)")
    assert json.loads(db.execute_json("INSERT INTO u VALUES (1, 'A\"b'), (2, NULL), (3, 'x,y')")) == {"ok": True, "columns": [], "rows": [], "rowsAffected": 3}
    assert json.loads(db.execute_json("SELECT * FROM u")) == {"ok": True, "columns": ["id", "name"], "rows": [[1, 'A"b'], [2, None], [3, "x,y"]], "rowsAffected": 3}
    bad = json.loads(db.execute_json("SELECT * FROM nope"))
    assert bad["ok"] is False and "no table" in bad["error"]
    assert Admin(db).csv_text("u") == 'id,name\n1,"A""b"\n2,\n3,"x,y"\n'
    assert to_csv(db.execute("SELECT name FROM u WHERE id = 2"), "NULL") == "name\nNULL\n"


def test_replica(rdb):
    fill(rdb, "products", "id INTEGER NOT NULL, name TEXT, price INTEGER", [(i, f"item_{i}", None if i % 5 == 0 else 10 * (i % 3)) for i in range(100)])
    rep = rdb.replica
    assert not rep.has_data("products") and rep.freshness() == 2
    assert rdb.flush_to_columnar() == {"products": 100} and rep.freshness() == 0
    q = lambda sql: [tuple(r) for r in rdb.query(sql, source="replica", settled=True).collect()]
    assert q("SELECT name, price FROM products WHERE id = 42") == [("item_42", 0)]
    assert len(q("SELECT * FROM products LIMIT 5")) == 5
    assert q("SELECT price, COUNT(*) FROM products GROUP BY price") == [(0, 27), (10, 27), (20, 26), (None, 20)]
    rdb.execute("INSERT INTO products VALUES (100, 'new', 1)")
    assert q("SELECT COUNT(*) FROM products") == [(100,)] and rdb.execute("SELECT COUNT(*) FROM products").rows == [(101,)]
    assert rdb.flush_to_columnar()["products"] == 1
    r = rep.reader("products")
    assert r.total_rows() == 101 and r.num_columns() == 3 and r.column_names() == ["id", "name", "price"]
    assert r.read_all().count() == 101 and r.read_filtered("id > 98").count() == 2 and r.read_projected(["id"]).columns == ["id"]
    assert [tuple(x) for x in r.read_filtered_projected("id = 100", ["name"]).collect()] == [("new",)]
    rdb.execute("DELETE FROM products WHERE id >= 50")
    rdb.flush_to_columnar()
    assert q("SELECT COUNT(*), MAX(id) FROM products") == [(50, 49)]


def test_replica_flushes_at_its_threshold(rdb):
    rdb.flush_threshold = 3
    fill(rdb, "logs", "ts INTEGER NOT NULL, msg TEXT", [(1, "a"), (2, "b")])
    assert not rdb.replica.has_data()
    rdb.execute("INSERT INTO logs VALUES (3, 'c')")
    assert rdb.replica.has_data("logs") and rdb.replica.reader("logs").total_rows() == 3


def test_admin(db, tmp_path):
    fill(db, "t", "k INTEGER NOT NULL, v TEXT", [(3, "c"), (1, "a"), (2, None)])
    a = Admin(db)
    assert a.list_tables() == [("t", 3)] and a.count("t") == 3
    assert a.describe("t")[0] == {"name": "k", "type": "bigint", "nullable": False, "default": None, "indexes": []}
    assert a.browse("t", 0, 2).rows == [(3, "c"), (1, "a")] and a.browse("t", 1, 2, "k").rows == [(3, "c")]
    assert a.insert_row("t", {"k": 4}) == 1 and a.update_row("t", {"k": 4}, {"v": "d"}) == 1 and a.delete_row("t", {"v": None}) == 1
    a.add_column("t", "x", "bigint")
    a.rename_column("t", "v", "w")
    assert db.execute("SELECT k, w, x FROM t ORDER BY k").rows == [(1, "a", None), (3, "c", None), (4, "d", None)]
    a.drop_column("t", "w")
    a.add_column("t", "w", "string")
    assert db.execute("SELECT w FROM t").rows == [(None,)] * 3
    a.set_nullable("t", "k", True)
    a.duplicate_table("t", "u")
    a.rename_table("t", "z")
    assert a.truncate("z") == 3 and db.execute("SELECT COUNT(*) FROM u").rows == [(3,)]
    a.export_csv("u", "file://" + str(tmp_path / "csv"))
    a.drop_table("z")
    assert a.list_tables() == [("u", 3)]
    assert db.vacuum() >= 1 and db.execute("SELECT COUNT(*) FROM u").rows == [(3,)]


def test_repl(db):
    from larkspan.__main__ import repl

    out = io.StringIO()
    repl(db, io.StringIO("CREATE TABLE t (a INTEGER, b TEXT)\nINSERT INTO t VALUES (1, NULL)\nSELECT * FROM t\nSELECT nope FROM t\nexit\nSELECT * FROM t\n"), out)
    assert out.getvalue().splitlines() == ["ok, 0 rows", "ok, 1 rows", "a | b", "1 | NULL", "error: unknown column nope"]


class Client:
    def __init__(self, port):
        self.s = socket.create_connection(("127.0.0.1", port), 60)
        self.s.sendall(struct.pack("!ii", 8, 80877103))
        assert self.s.recv(1) == b"N"
        body = struct.pack("!i", 196608) + b"user\0x\0\0"
        self.s.sendall(struct.pack("!i", len(body) + 4) + body)
        self.read()

    def exact(self, n):
        out = b""
        while len(out) < n:
            out += self.s.recv(n - len(out))
        return out

    def read(self):
        got = []
        while True:
            tag = self.exact(1)
            body = self.exact(struct.unpack("!i", self.exact(4))[0] - 4)
            got.append((tag, body))
            if tag == b"Z":
                return got

    def query(self, sql):
        body = sql.encode() + b"\0"
        self.s.sendall(b"Q" + struct.pack("!i", len(body) + 4) + body)
        return self.read()


def test_server(db):
    run(db, "CREATE TABLE t (id INTEGER, name TEXT)")
    with Server(db, ("127.0.0.1", 0)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        a, b = (Client(server.server_address[1]) for _ in range(2))
        assert a.query("INSERT INTO t VALUES (1, 'a;b'), (2, NULL)")[0] == (b"C", b"INSERT 0 2\0")
        got = b.query("SELECT id, name FROM t; SHOW TABLES")
        assert [t for t, _ in got] == [b"T", b"D", b"D", b"C", b"T", b"D", b"C", b"Z"]
        assert got[1][1] == struct.pack("!hi", 2, 1) + b"1" + struct.pack("!i", 3) + b"a;b" and got[2][1].endswith(struct.pack("!i", -1)) and got[3][1] == b"SELECT 2\0"
        assert a.query("BEGIN")[-1] == (b"Z", b"T") and a.query("INSERT INTO t VALUES (3, 'c')")[0][0] == b"C"
        assert b.query("SELECT COUNT(*) FROM t")[1][1].endswith(b"2")
        a.s.close()  # rolled back
        assert b.query("SELECT COUNT(*) FROM t")[1][1].endswith(b"2")
        assert b.query("SELEKT")[0][0] == b"E" and b.query("")[0][0] == b"I"
        server.shutdown()


def test_workspace(spark, tmp_path):
    from larkspan.errors import ExecError
    from larkspan.sources.workspace import Workspace

    w = Workspace(spark, str(tmp_path / "w"))
    run(w.create_schema("b"), "CREATE TABLE t (a INTEGER)", "INSERT INTO t VALUES (1)")
    w.create_schema("a")
    assert w.list_schemas() == ["a", "b"] and w.list_tables() == [("b", "t", 1)]
    for bad in ("b", "../x", "nope"):
        with pytest.raises(ExecError):
            w.drop_schema(bad)
    w.drop_schema("a")
    w.drop_schema("b", cascade=True)
    assert w.list_schemas() == []


def test_pages_and_routing(spark, tmp_path):
    db = Database.create(spark, str(tmp_path / "d"), replica_dir=str(tmp_path / "r"))
    fill(db, "t", "id INTEGER, v TEXT", [(i, f"v{i}") for i in range(10)])
    q = db.session().query_result("SELECT id FROM t ORDER BY id")
    assert q.page(1, 4) == [(4,), (5,), (6,), (7,)] and q.page(2, 4) == [(8,), (9,)] and q.page(9, 4) == []
    read = lambda: db.query("SELECT id FROM t", source="auto").inputFiles()[0]
    assert "/d/data" in read()  # never flushed
    db.flush_to_columnar()
    assert "/r/segments" in read()
    db.execute("INSERT INTO t VALUES (10, 'x')")
    assert "/d/data" in read()


def test_isolation_levels(db):
    fill(db, "t", "id INTEGER, v TEXT", [(1, "a"), (2, "b")])
    s = db.session(Isolation.READ_COMMITTED)
    s.execute("BEGIN")
    s.execute("INSERT INTO t VALUES (3, 'mine')")
    db.execute("INSERT INTO t VALUES (4, 'theirs')")
    assert sorted(s.execute("SELECT id FROM t").rows) == [(1,), (2,), (3,), (4,)]
    db.execute("UPDATE t SET v = 'new' WHERE id = 4")
    assert s.execute("UPDATE t SET v = 'over' WHERE id = 4").rows_affected == 1
    s.execute("COMMIT")
    assert sorted(db.execute("SELECT id, v FROM t").rows) == [(1, "a"), (2, "b"), (3, "mine"), (4, "over")]
    s.execute("BEGIN")
    s.execute("DELETE FROM t WHERE id = 1")
    db.execute("UPDATE t SET v = 'z' WHERE id = 1")
    with pytest.raises(TxnError):
        s.execute("COMMIT")


def test_type_changes_and_defaults(db):
    fill(db, "t", "id INTEGER, v TEXT", [(1, "10"), (2, None), (3, "-7")])
    admin = Admin(db)
    admin.change_type("t", "v", "bigint")
    assert db.execute("SELECT SUM(v) FROM t").rows == [(3,)]
    admin.change_type("t", "id", "string")
    admin.set_default("t", "v", 5)
    admin.insert_row("t", {"id": "x"})
    assert db.execute("SELECT id, v FROM t WHERE v > 4 ORDER BY v").rows == [("x", 5), ("1", 10)]
    assert [c["default"] for c in admin.describe("t")] == [None, 5]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        admin.change_type("t", "id", "bigint")
    assert db.execute("SELECT COUNT(*) FROM t WHERE id = 'x'").rows == [(1,)]
    with pytest.raises(BindError):
        admin.set_default("t", "v", "text")


def test_formatted_statements_mean_the_same():
    from larkspan.plans.format import format_sql
    from larkspan.plans.parser import parse
    from tests.test_parser import VALID

    for sql in VALID:
        assert parse(format_sql(sql)) == parse(sql) and format_sql(format_sql(sql)) == format_sql(sql), sql
    assert format_sql("select a from t where b='x' -- remark\n and c in(1,2);delete from t") == "SELECT a\nFROM t\nWHERE b = 'x'\n  AND c IN (1, 2);\nDELETE\nFROM t"
