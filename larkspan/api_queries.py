"""Registered queries of the interfaces around the dialect: host operators, row and batch scans, delivery, server, administration.

Each goes through the interface that it names and makes a relation of what it gives; the tables are the smallest ones, as these
interfaces hand rows to the caller.
"""

from __future__ import annotations

import io
import json
import socket
import struct
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.__main__ import repl
from larkspan.errors import BindError, EngineError, ExecError, ParseError, TxnError
from larkspan.operators import relational as R
from larkspan.plans.format import format_sql
from larkspan.plans.lexer import split_statements
from larkspan.queries import _nation as nation
from larkspan.queries import _query, database
from larkspan.server import Server
from larkspan.session import Database, Isolation
from larkspan.sources.admin import Admin
from larkspan.sources.fs import new_folder
from larkspan.sources.workspace import Workspace
from larkspan.streaming.replica import follow

KV = "k long, v string"
_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation"
_REGION = "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS v FROM region"
_COUNT = "SELECT count(*) AS n FROM nation"


def _region(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """The five regions, as rows of the host."""
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("cast(r_regionkey as long)", "r_name").collect()]


def _outcome(action: Callable[[], object]) -> str:
    try:
        action()
        return "done"
    except EngineError as e:
        return type(e).__name__


# rows of the host as relations


@_query(f"SELECT * FROM ({_REGION}) WHERE k > 0")
def vec_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep(R.vec_scan(spark, _region(spark, sf_dir), KV), F.col("k") > 0)


@_query(f"SELECT v, count(*) AS n FROM (SELECT * FROM ({_REGION}) UNION ALL SELECT * FROM ({_REGION})) GROUP BY v")
def batch_vec_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _region(spark, sf_dir)
    return R.hash_aggregate(R.vec_scan(spark, rows + rows, KV), ["v"], [F.count("*").alias("n")])


@_query("SELECT CAST(p * 5000 + i AS BIGINT) AS k, 'row ' || CAST(p * 5000 + i AS VARCHAR) AS v FROM range(3) a(p), range(5000) b(i)")
def row_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_scan(spark, lambda part: ((k, f"row {k}") for k in range(part * 5000, (part + 1) * 5000)), 3, KV)


@_query("SELECT c_custkey AS k, upper(c_name) AS v FROM customer")
def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("cast(c_custkey as long) as k", "c_name as v")
    return R.map_batches(df, lambda b: b.assign(v=b["v"].str.upper()), KV)


# statements


@_query("SELECT * FROM (VALUES ('by_v', 'ExecError', 'done')) t(made, gone, again)")
def drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    db.execute("CREATE INDEX by_v ON t (v)")
    made = " ".join(db.log.state().indexes)
    db.execute("DROP INDEX by_v")
    gone = _outcome(lambda: db.index("by_v"))
    return spark.createDataFrame([(made, gone, _outcome(lambda: db.execute("CREATE INDEX by_v ON t (v)")))], "made string, gone string, again string")


@_query(f"SELECT count(*) + 2 AS n, sum(k) + 301 AS s FROM ({_NATION})")
def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    with nation(spark, sf_dir).session() as s:
        got = s.execute_script("INSERT INTO t VALUES (100, 'semi;colon'); BEGIN; INSERT INTO t VALUES (201, $$it's$$); COMMIT;; SELECT COUNT(*), SUM(k) FROM t")
    return spark.createDataFrame(got[-1].rows, "n long, s long")


@_query("SELECT * FROM (VALUES (1, 'SELECT a FROM t'), (2, 'INSERT INTO t VALUES ('';'')'), (3, 'SELECT $x$a;$$b$x$ FROM t')) t(n, s)")
def statement_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(split_statements("SELECT a FROM t; INSERT INTO t VALUES (';');\n;SELECT $x$a;$$b$x$ FROM t;"), 1)), "n int, s string")


@_query("SELECT * FROM (VALUES (1, 'SELECT a, COUNT(*)'), (2, 'FROM t'), (3, 'LEFT JOIN u ON t.a = u.b'), (4, 'WHERE c BETWEEN 1 AND 2'), (5, '  AND d = ''Where''')) t(n, s)")
def formatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = format_sql("select a,count(*) from t left join u on t.a=u.b where c between 1 and 2 and d='Where'")
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "n int, s string")


@_query("SELECT * FROM (VALUES ('unknown function', 'BindError'), ('two arguments', 'BindError'), ('number in UPPER', 'BindError'), ('nested', 'BindError'), ('SUM of text', 'BindError'), ('aggregate in WHERE', 'BindError'), ('MAX of all', 'BindError'), ('half a statement', 'ParseError'), ('no table', 'BindError')) t(what, error)")
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    wrong = {
        "unknown function": "SELECT SOUNDEX(v) FROM t", "two arguments": "SELECT SUM(k, k) FROM t", "number in UPPER": "SELECT UPPER(k) FROM t", "nested": "SELECT MAX(SUM(k)) FROM t", "SUM of text": "SELECT SUM(v) FROM t",
        "aggregate in WHERE": "SELECT k FROM t WHERE SUM(k) > 1", "MAX of all": "SELECT MAX(*) FROM t", "half a statement": "SELECT k FROM", "no table": "SELECT k FROM nowhere",
    }
    assert issubclass(BindError, EngineError) and issubclass(ParseError, EngineError)
    return spark.createDataFrame([(what, _outcome(lambda q=q: db.execute(q))) for what, q in wrong.items()], "what string, error string")


@_query(f"SELECT n, 'ExecError' AS written FROM ({_COUNT})")
def execute_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    with nation(spark, sf_dir).session() as s:
        n = s.execute_read("SELECT COUNT(*) FROM t").rows[0][0]
        return spark.createDataFrame([(n, _outcome(lambda: s.execute_read("DELETE FROM t")))], "n long, written string")


# scans and delivery


@_query(_NATION)
def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(nation(spark, sf_dir).scan_rows("t")), KV)


@_query(_NATION)
def scan_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows: list[tuple] = []
    nation(spark, sf_dir).scan_all_rows("t", rows.append)
    return spark.createDataFrame(rows, KV)


@_query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS INTEGER) AS batch FROM nation")
def scan_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, got = database(spark), []
    db.execute("CREATE TABLE t (k INTEGER NOT NULL, v TEXT)")
    db.load("t", spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey"))
    db.scan_batched("t", 10, got.append)
    return spark.createDataFrame([(*r, i) for i, b in enumerate(got) for r in b.rows()], f"{KV}, batch int")


@_query(_COUNT)
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(nation(spark, sf_dir).row_count("t"),)], "n long")


@_query(f"SELECT * FROM ({_NATION}) ORDER BY v DESC LIMIT 12")
def query_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = nation(spark, sf_dir).session().query_result("SELECT k, v FROM t ORDER BY v DESC LIMIT 12").with_batch_size(5)
    first = r.next_batch()
    return spark.createDataFrame(first.rows() + r.collect_all(), KV)


@_query(f"SELECT * FROM ({_NATION}) ORDER BY v LIMIT 5 OFFSET 10")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(nation(spark, sf_dir).session().query_result("SELECT k, v FROM t ORDER BY v").page(2, 5), KV)


@_query(f"SELECT k, CASE WHEN k % 2 = 0 THEN v END AS v FROM ({_NATION})")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = json.loads(nation(spark, sf_dir).execute_json("SELECT k, CASE WHEN k % 2 = 0 THEN v END AS v FROM t"))
    assert got["ok"] and got["columns"] == ["k", "v"] and got["rowsAffected"] == len(got["rows"])
    return spark.createDataFrame([tuple(r) for r in got["rows"]], KV)


@_query(f"SELECT CAST(k AS VARCHAR) || ' | ' || v AS line FROM ({_NATION}) UNION ALL SELECT * FROM (VALUES ('k | v'), ('ok, 1 rows'), ('error: no table nowhere'))")
def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, out = nation(spark, sf_dir), io.StringIO()
    repl(db, io.StringIO("SELECT k, v FROM t\n\nINSERT INTO t VALUES (100, 'x')\nSELECT a FROM nowhere\n\\q\nSELECT k FROM t\n"), out)
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


@_query(f"SELECT k, CASE WHEN k = 1 THEN 'a, \"b\"' WHEN k <> 2 THEN v END AS v FROM ({_NATION})")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, folder = nation(spark, sf_dir), f"{new_folder(spark)}/csv"
    db.execute("UPDATE t SET v = 'a, \"b\"' WHERE k = 1")
    db.execute("UPDATE t SET v = NULL WHERE k = 2")
    Admin(db).export_csv("t", folder)
    return spark.read.schema(KV).csv(folder, header=True, quote='"', escape='"')


@_query(f"SELECT CAST(k AS VARCHAR) || ',' || v AS line FROM ({_NATION}) UNION ALL SELECT 'k,v'")
def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in Admin(nation(spark, sf_dir)).csv_text("t").splitlines()], "line string")


def _ask(port: int, sql: str) -> list[tuple[str, bytes]]:
    """(tag, body) of all messages that a simple query brings."""
    with socket.create_connection(("127.0.0.1", port)) as c:
        f = c.makefile("rb")
        c.sendall(struct.pack("!ii", 9, 196608) + b"\0")

        def until_ready() -> list[tuple[str, bytes]]:
            out = []
            while True:
                tag = f.read(1)
                out.append((tag.decode(), f.read(struct.unpack("!i", f.read(4))[0] - 4)))
                if tag == b"Z":
                    return out

        until_ready()
        body = sql.encode() + b"\0"
        c.sendall(b"Q" + struct.pack("!i", len(body) + 4) + body)
        got = until_ready()
        c.sendall(b"X" + struct.pack("!i", 4))
        return got


def _served(db: Database, sql: str) -> list[tuple[str, bytes]]:
    with Server(db, ("127.0.0.1", 0)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        try:
            return _ask(server.server_address[1], sql)
        finally:
            server.shutdown()


def _cells(body: bytes) -> list[str | None]:
    out, at = [], 2
    for _ in range(struct.unpack("!h", body[:2])[0]):
        n = struct.unpack("!i", body[at : at + 4])[0]
        at += 4
        out.append(None if n < 0 else body[at : at + n].decode())
        at += max(n, 0)
    return out


@_query(f"SELECT CAST(k AS VARCHAR) AS k, CASE WHEN k > 3 THEN v END AS v FROM ({_NATION})")
def wire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _served(nation(spark, sf_dir), "SELECT k, CASE WHEN k > 3 THEN v END AS v FROM t")
    return spark.createDataFrame([tuple(_cells(b)) for t, b in got if t == "D"], "k string, v string")


@_query("SELECT * FROM (VALUES (0, 'CREATE TABLE'), (1, 'BEGIN'), (2, 'INSERT 0 2'), (3, 'UPDATE 1'), (4, 'SELECT 2'), (5, 'DELETE 2'), (6, 'ROLLBACK'), (7, 'DROP TABLE')) t(n, tag)")
def wire_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CREATE TABLE w (a INTEGER); BEGIN; INSERT INTO w VALUES (1), (2); UPDATE w SET a = 3 WHERE a = 2; SELECT a FROM w; DELETE FROM w; ROLLBACK; DROP TABLE w"
    return spark.createDataFrame([(i, b.rstrip(b"\0").decode()) for i, b in enumerate(b for t, b in _served(database(spark), text) if t == "C")], "n int, tag string")


@_query(_COUNT)
def disconnect_rolls_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    _served(db, "BEGIN; INSERT INTO t VALUES (100, 'lost')")
    return db.query("SELECT COUNT(*) AS n FROM t")


# replica


@_query(f"SELECT v FROM ({_NATION})")
def replica_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir, replica=True)
    db.flush_to_columnar()
    return db.replica.reader("t").read_projected(["v"])


@_query("SELECT count(*) AS total_rows, 2 AS num_columns, 'k v' AS column_names FROM nation")
def replica_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir, replica=True)
    db.flush_to_columnar()
    r = db.replica.reader("t")
    return spark.createDataFrame([(r.total_rows(), r.num_columns(), " ".join(r.column_names()))], "total_rows long, num_columns int, column_names string")


@_query(_NATION)
def replica_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing asks for a flush: the rows waiting for one do."""
    return nation(spark, sf_dir, replica=True, flush_threshold=20).query("SELECT k, v FROM t", source="replica")


@_query(f"SELECT n AS routed, n + 1 AS behind, n + 2 AS inside FROM ({_COUNT})")
def replica_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``auto`` reads the replica while it is fresh, the rows when it is behind or a transaction has rows of its own."""
    db = nation(spark, sf_dir, replica=True)
    db.flush_to_columnar()
    count = lambda s: s.query("SELECT COUNT(*) FROM t", source="auto").first()[0]
    routed = count(db)
    assert "segments" in str(db.query("SELECT k FROM t", source="auto").inputFiles())
    db.execute("INSERT INTO t VALUES (100, 'x')")
    behind = count(db)
    with db.session() as s:
        s.execute("BEGIN")
        s.execute("INSERT INTO t VALUES (101, 'x')")
        return spark.createDataFrame([(routed, behind, count(s))], "routed long, behind long, inside long")


@_query("SELECT * FROM (VALUES (1, 'create_table'), (2, 'add_files'), (3, 'add_files'), (4, 'replace_files'), (5, 'drop_table')) t(version, op)")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, got = nation(spark, sf_dir), []
    at = f"{new_folder(spark)}/feed"
    db.execute("INSERT INTO t VALUES (100, 'x')")
    follow(spark, db.log, lambda v, ops: got.extend((v, op["op"]) for op in ops), at)
    db.execute("DELETE FROM t WHERE k = 100")
    db.execute("DROP TABLE t")
    follow(spark, db.log, lambda v, ops: got.extend((v, op["op"]) for op in ops), at)
    return spark.createDataFrame(got, "version int, op string")


# transactions


@_query("SELECT * FROM (VALUES ('first', 'done'), ('second', 'TxnError'), ('insert', 'done'), ('value', 'a')) t(what, outcome)")
def first_committer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    a, b, c = db.session(), db.session(), db.session()
    for s, sql in ((a, "UPDATE t SET v = 'a' WHERE k = 1"), (b, "UPDATE t SET v = 'b' WHERE k = 1"), (c, "INSERT INTO t VALUES (100, 'c')")):
        s.execute("BEGIN")
        s.execute(sql)
    out = [("first", _outcome(lambda: a.execute("COMMIT"))), ("second", _outcome(lambda: b.execute("COMMIT"))), ("insert", _outcome(lambda: c.execute("COMMIT")))]
    return spark.createDataFrame([*out, ("value", db.execute("SELECT v FROM t WHERE k = 1").rows[0][0])], "what string, outcome string")


@_query(f"SELECT n AS snapshot, n + 1 AS read_committed FROM ({_COUNT})")
def isolation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    seen = [db.session(level) for level in (Isolation.SNAPSHOT, Isolation.READ_COMMITTED)]
    for s in seen:
        s.execute("BEGIN")
    db.execute("INSERT INTO t VALUES (100, 'new')")
    return spark.createDataFrame([tuple(s.execute("SELECT COUNT(*) FROM t").rows[0][0] for s in seen)], "snapshot long, read_committed long")


@_query("SELECT * FROM (VALUES ('another format', 'ExecError'), ('made twice', 'ExecError'), ('nothing there', 'ExecError')) t(what, outcome)")
def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    folder = db.log.files.url("").rstrip("/")
    twice = _outcome(lambda: Database.create(spark, folder))
    db.log.files.replace("_meta.json", json.dumps({"format": 99}).encode())
    out = [("another format", _outcome(lambda: Database.open(spark, folder))), ("made twice", twice), ("nothing there", _outcome(lambda: Database.open(spark, folder + "/none")))]
    assert issubclass(ExecError, EngineError) and issubclass(TxnError, EngineError)
    return spark.createDataFrame(out, "what string, outcome string")


# administration


@_query("SELECT * FROM (VALUES ('one', 'region', 5), ('two', 'empty', 0)) t(schema_name, table_name, n)")
def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, new_folder(spark))
    one = w.create_schema("one")
    one.execute("CREATE TABLE region (k INTEGER, v TEXT)")
    one.load("region", R.vec_scan(spark, _region(spark, sf_dir), KV))
    w.create_schema("two").execute("CREATE TABLE empty (a INTEGER)")
    w.create_schema("three")
    w.drop_schema("three")
    assert w.list_schemas() == ["one", "two"]
    return spark.createDataFrame(w.list_tables(), "schema_name string, table_name string, n int")


@_query(f"SELECT 't' AS name, n AS rows, n AS counted FROM ({_COUNT})")
def admin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    admin = Admin(nation(spark, sf_dir))
    return spark.createDataFrame([(*x, admin.count("t")) for x in admin.list_tables()], "name string, rows long, counted long")


@_query("SELECT * FROM (VALUES ('k', 'bigint', false, ''), ('v', 'string', true, 'by_v')) t(name, type, nullable, indexes)")
def admin_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    db.execute("CREATE INDEX by_v ON t (v)")
    return spark.createDataFrame([(c["name"], c["type"], c["nullable"], " ".join(c["indexes"])) for c in Admin(db).describe("t")], "name string, type string, nullable boolean, indexes string")


@_query(f"SELECT k, CASE WHEN k = 7 THEN 'seven' ELSE v END AS v FROM ({_NATION}) WHERE k <> 3 UNION ALL SELECT 100, NULL")
def admin_edit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    admin = Admin(db)
    admin.insert_row("t", {"k": 100})
    admin.update_row("t", {"k": 7}, {"v": "seven"})
    admin.delete_row("t", {"k": 3})
    return db.query("SELECT k, v FROM t")


@_query(f"SELECT CAST(k AS VARCHAR) AS k, v FROM ({_NATION}) WHERE CAST(k AS VARCHAR) LIKE '1%'")
def admin_change_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    Admin(db).change_type("t", "k", "string")
    return db.query("SELECT k, v FROM t WHERE k LIKE '1%'")


@_query("SELECT * FROM (VALUES (1, 'none given'), (2, 'own'), (3, NULL)) t(k, v)")
def admin_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark)
    db.execute("CREATE TABLE t (k INTEGER, old TEXT)")
    admin = Admin(db)
    admin.set_default("t", "old", "none given")
    admin.rename_column("t", "old", "v")
    admin.insert_row("t", {"k": 1})
    admin.insert_row("t", {"k": 2, "v": "own"})
    admin.set_default("t", "v", None)
    admin.insert_row("t", {"k": 3})
    return db.query("SELECT k, v FROM t")


@_query("SELECT 0 AS left_in_t, count(*) AS renamed FROM nation")
def admin_rename_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = nation(spark, sf_dir)
    admin = Admin(db)
    admin.rename_table("t", "old")
    admin.duplicate_table("old", "t")
    admin.truncate("t")
    return spark.createDataFrame([(admin.count("t"), admin.count("old"))], "left_in_t int, renamed long")
