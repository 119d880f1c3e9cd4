"""Tables as immutable Parquet files that the commit log names. Files that no version names are garbage, so nothing is ever undone."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from larkspan.errors import BindError, ExecError, TxnError
from larkspan.plans.planner import RID
from larkspan.sources.log import CommitLog, State, Table

_ARROW = {"bigint": pa.int64(), "string": pa.string()}
MIN_INT, MAX_INT = -(1 << 63), (1 << 63) - 1


def physical(col_id: int) -> str:
    """Name in the files; columns are known by number there, so that renames touch no data."""
    return f"c{col_id}"


class Store:
    def __init__(self, spark: SparkSession, log: CommitLog):
        self.spark, self.log = spark, log

    # reading

    def table(self, state: State, name: str) -> Table:
        if name not in state.tables:
            raise BindError(f"no table {name}")
        return state.tables[name]

    def schema(self, t: Table) -> T.StructType:
        kinds = {"bigint": T.LongType(), "string": T.StringType()}
        return T.StructType([T.StructField(RID, T.LongType()), *[T.StructField(physical(c[3]), kinds[c[1]]) for c in t.columns]])

    def frame(self, t: Table, staged: Sequence[tuple] = (), file: str = "") -> DataFrame:
        """The rows of the files that ``t`` names, and ``staged`` rows (rid first), under column names. Columns added later are null in old files.

        ``file`` names a further column: the last part of the path of a row's file. Pages are checked against their checksums.
        """
        schema = self.schema(t)
        names = [F.col(RID), *[F.col(physical(c[3])).alias(c[0]) for c in t.columns]]
        paths = [self.log.files.url(f["path"]) for f in t.files]
        df = None
        if paths:
            df = self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)
            df = df.select(*names, *([F.col("_metadata.file_name").alias(file)] if file else []))
        if staged or df is None:
            own = self.spark.createDataFrame(list(staged), schema).select(*names, *([F.lit("").alias(file)] if file else []))
            df = own if df is None else df.unionByName(own)
        return df

    # writing

    def checked(self, name: str, t: Table, rows: Sequence[Sequence]) -> list[tuple]:
        for row in rows:
            if len(row) != len(t.columns):
                raise ExecError(f"{name} has {len(t.columns)} columns, {len(row)} values given")
            for v, (col, kind, nullable, _) in zip(row, t.columns):
                if v is None:
                    if not nullable:
                        raise ExecError(f"column {col} does not take NULL")
                elif kind == "bigint" and (not isinstance(v, int) or isinstance(v, bool)) or kind == "string" and not isinstance(v, str):
                    raise ExecError(f"column {col} is {'INTEGER' if kind == 'bigint' else 'TEXT'}, {v!r} is not")
                elif kind == "bigint" and not MIN_INT <= v <= MAX_INT:
                    raise ExecError(f"{v} is out of range for column {col}")
        return [tuple(r) for r in rows]

    def write_rows(self, name: str, t: Table, rows: Sequence[tuple]) -> dict:
        """One file of rows (rid first) that are on the driver already: literals of INSERT."""
        schema = pa.schema([(RID, pa.int64()), *[(physical(c[3]), _ARROW[c[1]]) for c in t.columns]])
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rel, sink = f"data/{name}/part-{uuid.uuid4().hex}.parquet", pa.BufferOutputStream()
        pq.write_table(table, sink, write_page_checksum=True)
        self.log.files.create(rel, sink.getvalue().to_pybytes())
        return {"path": rel, "rows": len(rows)}

    def write_frame(self, name: str, t: Table, df: DataFrame, bloom: Sequence[str] = (), sort: str | None = None) -> tuple[list[dict], int]:
        """Files of a DataFrame with RID and the table's columns, written by the executors, and the largest row id in them (-1 without rows)."""
        rel = f"data/{name}/set-{uuid.uuid4().hex}"
        out = df.select(RID, *[F.col(c[0]).alias(physical(c[3])) for c in t.columns])
        ids = {c[0]: physical(c[3]) for c in t.columns}
        if sort:
            out = out.repartitionByRange(ids[sort]).sortWithinPartitions(ids[sort])
        w = out.write.option("parquet.page.write-checksum.enabled", "true")
        for c in bloom:
            w = w.option(f"parquet.bloom.filter.enabled#{ids[c]}", "true")
        w.parquet(self.log.files.url(rel))
        # row counts and largest ids come from the files' footers
        written = self.spark.read.schema(self.schema(t)).parquet(self.log.files.url(rel)).groupBy(F.col("_metadata.file_name").alias("f"))
        got = sorted(written.agg(F.count("*").alias("n"), F.max(RID).alias("top")).collect(), key=lambda r: r["f"])
        return [{"path": f"{rel}/{r['f']}", "rows": r["n"]} for r in got], max([r["top"] for r in got], default=-1)

    def commit(self, base: State, make: Callable[[State], list[dict]]) -> State:
        """Commit what ``make`` derives from the latest state; on a lost race derive it again. ``make`` raises where that state forbids it."""
        while True:
            now = self.log.state()
            ops = make(now)
            if not ops:
                return now
            if self.log.try_commit(now.version + 1, ops):
                return self.log.state()

    def same_table(self, now: State, name: str, born: int) -> Table:
        t = now.tables.get(name)
        if t is None or t.born != born:
            raise TxnError(f"table {name} was dropped by another transaction")
        return t
