"""Several databases side by side, as schemas of one folder."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from larkspan.errors import ExecError
from larkspan.session import Database
from larkspan.sources.fs import files_of


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, files_of(spark, folder)

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ExecError(f"{name!r} is not a schema name")
        return f"{self.folder}/{name}"

    def list_schemas(self) -> list[str]:
        return [x for x in self.files.names("") if self.files.exists(f"{x}/_meta.json")]

    def create_schema(self, name: str) -> Database:
        return Database.create(self.spark, self._path(name))

    def open_schema(self, name: str) -> Database:
        return Database.open(self.spark, self._path(name))

    def drop_schema(self, name: str, cascade: bool = False) -> None:
        """A schema with tables goes only with ``cascade``."""
        if self.open_schema(name).log.state().tables and not cascade:
            raise ExecError(f"schema {name} has tables")
        self.files.delete_tree(name)

    def list_tables(self) -> list[tuple[str, str, int]]:
        """(schema, table, rows) of all schemas, from their logs."""
        return [(s, n, t.rows) for s in self.list_schemas() for n, t in sorted(self.open_schema(s).log.state().tables.items())]
