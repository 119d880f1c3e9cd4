"""The operators as an API, and plans."""

from pyspark.sql import functions as F

from larkspan.operators import relational as R
from larkspan.queries import tables
from larkspan.sources.files import Frames, read_csv
from larkspan.streaming.replica import follow
from tests.test_sql import fill


def frame(spark):
    return R.vec_scan(spark, [(1, "a"), (2, None), (None, "c"), (2, "b")], "k long, v string")


def test_api(spark):
    df = frame(spark)
    rows = lambda d: [tuple(r) for r in d.collect()]
    assert rows(R.project(df, [1, 0]))[0] == ("a", 1)
    assert rows(R.keep(df, F.col("k") > 1)) == [(2, None), (2, "b")]
    assert rows(R.sort(df, [(F.col("k"), True), (F.col("v"), False)])) == [(None, "c"), (2, "b"), (2, None), (1, "a")]
    assert rows(R.limit(R.sort(df, [(F.col("k"), False)]), 1, 3)) == [(None, "c")]
    assert sorted(rows(R.hash_aggregate(df, ["k"], [F.count("v").alias("n")])), key=str) == [(1, 1), (2, 1), (None, 1)]
    assert rows(R.hash_aggregate(df.where("k > 9"), [], [F.count(F.lit(1)).alias("n"), F.sum("k").alias("s")])) == [(0, None)]
    assert R.count_rows(df) == 4
    other = R.vec_scan(spark, [(2, "x"), (None, "y")], "j long, w string")
    assert sorted(rows(R.equi_join(df, other, "k", "j")), key=str) == [(2, "b", 2, "x"), (2, None, 2, "x")]
    assert rows(R.map_batches(df, lambda b: b.assign(v=b.v.fillna("-")), "k long, v string"))[1] == (2, "-")
    assert len(rows(R.set_operation(df, df, "UNION"))) == 4 and len(rows(R.set_operation(df, df, "UNION", True))) == 8
    assert rows(R.set_operation(df, other, "EXCEPT", True)) and not rows(R.set_operation(df, df, "EXCEPT"))


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_push_down_prune_and_keep_the_top_only(spark, tmp_path):
    d = str(tmp_path)
    spark.range(1000).selectExpr("cast(id as int) k", "cast(id as string) v", "id w").write.parquet(f"{d}/t.parquet")
    t = tables(spark, d)
    p = plan(t.query("SELECT v FROM t WHERE k > 990 AND v LIKE '99%'"))
    assert "PushedFilters: [IsNotNull(k)" in p and "GreaterThan(k,990)" in p and "ReadSchema: struct<k:int,v:string>" in p and "Python" not in p
    assert "TakeOrderedAndProject" in plan(t.query("SELECT k FROM t ORDER BY w DESC LIMIT 5"))
    g = plan(t.query("SELECT k % 3, COUNT(*), SUM(w) FROM t GROUP BY k % 3"))
    assert "partial_count" in g and "partial_sum" in g and "ReadSchema: struct<k:int,w:bigint>" in g


def test_frames_and_csv(spark, tmp_path):
    f = Frames(spark, {"x": lambda: frame(spark)})
    assert f.query("SELECT v FROM x WHERE k = 1").collect()[0][0] == "a"
    (tmp_path / "a.csv").write_text('k,v\n1,"a,""b"\n2,\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), "k long, v string").collect()] == [(1, 'a,"b'), (2, None)]


def test_change_feed(db, tmp_path):
    fill(db, "t", "k INTEGER", [(1,)])
    seen = []
    checkpoint = str(tmp_path / "c")
    assert follow(db.spark, db.log, lambda v, ops: seen.append((v, ops[0]["op"])), checkpoint) == 2
    db.execute("INSERT INTO t VALUES (2)")
    assert follow(db.spark, db.log, lambda v, ops: seen.append((v, ops[0]["op"])), checkpoint) == 1
    assert seen == [(1, "create_table"), (2, "add_files"), (3, "add_files")]
