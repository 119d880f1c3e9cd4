"""A columnar replica that a Structured Streaming query keeps up to date from the commit log.

Each flush is a run of the query with ``availableNow``: new log files are its input, ``foreachBatch`` appends their rows to
the replica's segments, and the stream's checkpoint remembers what was read. A batch writes under names that follow from its id
and publishes one state file, so a batch that is run again leaves what the first run left.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.errors import BindError, ExecError
from larkspan.plans.planner import RID, Relation
from larkspan.sources.fs import files_of
from larkspan.sources.log import CommitLog, FileList, State, Table
from larkspan.sources.store import Store, physical


class Replica:
    def __init__(self, spark: SparkSession, log: CommitLog, folder: str):
        self.spark, self.log, self.files = spark, log, files_of(spark, folder)
        self._store = Store(spark, log)

    def state(self) -> dict:
        """``{"version", "tables": {name: {"born", "segments": [{"path", "rows"}]}}}`` of the latest batch."""
        return self._state_before(None)

    def _state_before(self, batch: int | None) -> dict:
        got = [x for x in self.files.names("_state") if x.endswith(".json") and (batch is None or int(x[:-5]) < batch)]
        return json.loads(self.files.read(f"_state/{got[-1]}")) if got else {"version": 0, "tables": {}}

    def fresh(self) -> bool:
        """Whether the replica holds all that is committed."""
        return self.freshness() == 0

    def freshness(self) -> int:
        """Commits that the replica lacks."""
        return self.log.state().version - self.state()["version"]

    def has_data(self, table: str | None = None) -> bool:
        tables = self.state()["tables"]
        return any(t["segments"] for n, t in tables.items() if table in (None, n))

    def flush(self) -> dict[str, int]:
        """Bring the replica up to the latest commit; returns the rows written by table."""
        before = self.state()
        done: dict[str, int] = {}
        log_files = (
            self.spark.readStream.format("text").option("pathGlobFilter", "*.json").option("wholetext", True)
            .load(self.log.files.url("_log")).select("value", F.col("_metadata.file_name").alias("name"))
        )
        q = (
            log_files.writeStream.foreachBatch(lambda df, batch: self._apply(df, batch, done))
            .option("checkpointLocation", self.files.url("_checkpoint")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        if (e := q.exception()) is not None:
            raise ExecError(f"the replica could not be flushed: {e}")
        for name in self.state()["tables"]:
            if name in before["tables"]:
                done.setdefault(name, 0)
        return done

    def _apply(self, df: DataFrame, batch: int, done: dict[str, int]) -> None:
        versions = sorted(int(r["name"][:-5]) for r in df.select("name").collect())  # names of commits, no rows of tables
        state = self._state_before(batch)
        base = self.log.state()
        add: dict[str, list[dict]] = {}
        for v in versions:
            for op in self.log.read(v):
                name = op.get("table")
                match op["op"]:
                    case "create_table":
                        state["tables"][name], add[name] = {"born": v, "segments": []}, []
                    case "drop_table":
                        state["tables"].pop(name, None)
                        add.pop(name, None)
                    case "rename_table":
                        state["tables"][op["to"]] = state["tables"].pop(name)
                        add[op["to"]] = add.pop(name, [])
                    case "copy_table":
                        state["tables"][op["to"]] = {"born": v, "segments": list(state["tables"][name]["segments"])}
                        add[op["to"]] = list(add.get(name, []))
                    case "set_files":
                        state["tables"][name]["segments"], add[name] = [], list(op["files"])
                    case "replace_files":
                        # rows of earlier segments changed: the table is taken anew as of this version
                        state["tables"][name]["segments"], add[name] = [], list(self.log.state_at(v).tables[name].files)
                    case "add_files":
                        add.setdefault(name, []).extend(op["files"])
        for name, files in add.items():
            t = base.tables.get(name)
            if not files or t is None or t.born != state["tables"][name]["born"]:
                continue  # dropped since: a later batch takes it away
            rel = f"segments/{name}-{batch:09d}"
            rows = Table(t.columns, FileList(files))
            out = self._store.frame(rows)
            out.select(RID, *[F.col(f"`{c[0]}`").alias(physical(c[3])) for c in t.columns]).write.mode("overwrite").parquet(self.files.url(rel))
            state["tables"][name]["segments"].append({"path": rel, "rows": rows.rows})
            done[name] = done.get(name, 0) + rows.rows
        state["version"] = max([state["version"], *versions])
        self.files.replace(f"_state/{batch:020d}.json", json.dumps(state).encode())

    def _table(self, name: str) -> tuple[Table, list[dict]]:
        t, s = self.log.state().tables.get(name), self.state()["tables"].get(name)
        if t is None:
            raise BindError(f"no table {name}")
        if s is None or s["born"] != t.born:
            return t, []
        return t, s["segments"]

    def relation(self, name: str) -> Relation:
        t, segments = self._table(name)
        schema = self._store.schema(t)
        paths = [self.files.url(s["path"]) for s in segments]
        df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return Relation(df.select(RID, *[F.col(physical(c[3])).alias(c[0]) for c in t.columns]), rid=True)

    def reader(self, table: str) -> ColumnarReader:
        return ColumnarReader(self, table)


class ColumnarReader:
    """A table's segments. Filters and column choices reach the Parquet scan."""

    def __init__(self, replica: Replica, table: str):
        self.replica, self.table = replica, table
        self.columns, self.segments = replica._table(table)

    def total_rows(self) -> int:
        return sum(s["rows"] for s in self.segments)

    def column_names(self) -> list[str]:
        return [c[0] for c in self.columns.columns]

    def num_columns(self) -> int:
        return len(self.columns.columns)

    def read_all(self) -> DataFrame:
        return self.replica.relation(self.table).df.drop(RID)

    def read_filtered(self, predicate: Column | str) -> DataFrame:
        return self.read_all().filter(predicate)

    def read_projected(self, columns: Sequence[str]) -> DataFrame:
        return self.read_all().select(*[f"`{c}`" for c in columns])

    def read_filtered_projected(self, predicate: Column | str, columns: Sequence[str]) -> DataFrame:
        return self.read_filtered(predicate).select(*[f"`{c}`" for c in columns])


def follow(spark: SparkSession, log: CommitLog, on_commit: Callable[[int, list[dict]], None], checkpoint: str) -> int:
    """Hand each commit since the last call to ``on_commit``, in order; returns how many. For consumers other than the replica."""
    seen = 0

    def run(df: DataFrame, _batch: int) -> None:
        nonlocal seen
        for v in sorted(int(r["name"][:-5]) for r in df.select("name").collect()):
            on_commit(v, log.read(v))
            seen += 1

    src = spark.readStream.format("text").option("pathGlobFilter", "*.json").option("wholetext", True).load(log.files.url("_log")).select(F.col("_metadata.file_name").alias("name"))
    q = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return seen


__all__ = ["ColumnarReader", "Replica", "State", "follow"]
