"""Files of other writers as tables of the dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from larkspan.errors import BindError
from larkspan.plans.planner import Planned, Planner, Relation
from larkspan.plans import ast as A
from larkspan.plans.parser import parse_one


class Frames:
    """Named DataFrames to query; ``views`` are functions from the session, so that nothing is read before it is needed."""

    def __init__(self, spark: SparkSession, views: dict[str, Callable[[], DataFrame]]):
        self.spark, self.views = spark, views

    def relation(self, name: str) -> Relation:
        if name not in self.views:
            raise BindError(f"no table {name}")
        return Relation(self.views[name]())

    def plan(self, sql: str) -> Planned:
        q = parse_one(sql)
        if not isinstance(q, A.Query):
            raise BindError("only SELECT runs here")
        return Planner(self.relation).plan(q)

    def query(self, sql: str) -> DataFrame:
        return self.plan(sql).df


class ParquetTables(Frames):
    """``<folder>/<name>.parquet`` as table ``name``; further ``views`` may be given. The folder may be in any store that Spark reads.

    A table's files and schema are listed once; ``refresh`` forgets them, for folders that others write to.
    """

    def __init__(self, spark: SparkSession, folder: str, views: dict[str, Callable[[], DataFrame]] | None = None):
        super().__init__(spark, views or {})
        self.folder = folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def refresh(self) -> None:
        self._known.clear()

    def relation(self, name: str) -> Relation:
        if name in self.views:
            return super().relation(name)
        if name not in self._known:
            try:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            except AnalysisException as e:
                raise BindError(f"no table {name}: {str(e).splitlines()[0]}") from e
        return Relation(self._known[name])


def read_csv(spark: SparkSession, path: str, schema: str, null: str = "") -> DataFrame:
    """CSV with a header line; a schema is given, so nothing is read twice to infer one."""
    return spark.read.csv(path, schema=schema, header=True, nullValue=null, escape='"', multiLine=True)
