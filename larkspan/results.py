"""Results as rows, bounded batches, JSON or CSV."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 2048


@dataclass
class ExecResult:
    """``rows_affected``: rows written, returned or, from a batch sink, sent."""

    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    rows_affected: int = 0


@dataclass
class Batch:
    """Columns of up to :data:`BATCH` rows."""

    columns: list[str]
    data: list[list]

    @property
    def row_count(self) -> int:
        return len(self.data[0]) if self.data else 0

    def rows(self) -> list[tuple]:
        return list(zip(*self.data))


def unique_names(names: list[str]) -> list[str]:
    """Names for a transport that knows no repeated labels."""
    return [f"{i}:{n}" for i, n in enumerate(names)]


def collect(df: DataFrame) -> ExecResult:
    rows = [tuple(r) for r in df.collect()]
    return ExecResult(df.columns, rows, len(rows))


def batches(df: DataFrame, size: int = BATCH) -> Iterator[Batch]:
    """A result in order, one partition at a time: executors encode Arrow batches, the driver holds a partition's at most.

    A failing row raises; nothing ends a stream early in silence.
    """
    names = df.columns

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for s in range(0, p.num_rows, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, p.schema) as w:
                    w.write_batch(p.slice(s, size))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["b"])

    held: list[pa.RecordBatch] = []
    count = 0

    def cut(final: bool) -> Iterator[Batch]:
        nonlocal held, count
        if not held or count < size and not final:
            return
        t = pa.Table.from_batches(held)
        end = count if final else count - count % size
        for s in range(0, end, size):
            part = t.slice(s, min(size, end - s))
            yield Batch(names, [c.to_pylist() for c in part.columns])
        held = t.slice(end).to_batches()
        count -= end

    for row in df.toDF(*unique_names(names)).mapInArrow(encode, "b binary").toLocalIterator(prefetchPartitions=True):
        for b in pa.ipc.open_stream(row[0]):
            held.append(b)
            count += b.num_rows
        yield from cut(False)
    yield from cut(True)


class QueryResult:
    """A result to pull: ``next_batch``, ``collect_all`` or iteration over rows."""

    def __init__(self, df: DataFrame, size: int = BATCH):
        self.df, self.columns, self.size, self.done = df, df.columns, size, False
        self._source: Iterator[Batch] | None = None

    def with_batch_size(self, size: int) -> QueryResult:
        if size < 1:
            raise ValueError("a batch holds one row at least")
        return QueryResult(self.df, size)

    def next_batch(self) -> Batch | None:
        if self._source is None:
            self._source = batches(self.df, self.size)
        got = next(self._source, None)
        self.done = got is None
        return got

    def page(self, number: int, size: int = 100) -> list[tuple]:
        """One page of the rows, from 0; the others stay where they are."""
        return [tuple(r) for r in self.df.offset(number * size).limit(size).collect()]

    def is_exhausted(self) -> bool:
        return self.done

    def collect_all(self) -> list[tuple]:
        return list(self)

    def __iter__(self) -> Iterator[tuple]:
        while (b := self.next_batch()) is not None:
            yield from b.rows()


def to_json(r: ExecResult) -> str:
    return json.dumps({"ok": True, "columns": r.columns, "rows": [list(x) for x in r.rows], "rowsAffected": r.rows_affected}, ensure_ascii=False)


def error_json(e: Exception) -> str:
    return json.dumps({"ok": False, "error": str(e)}, ensure_ascii=False)


def to_csv(r: ExecResult, null: str = "") -> str:
    """CSV text; values with a quote, comma or line break are quoted. ``null`` is empty for table exports, ``NULL`` for result grids."""

    def cell(v: object) -> str:
        s = null if v is None else str(v)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in '",\n\r') else s

    return "\n".join(",".join(map(cell, row)) for row in [tuple(r.columns), *r.rows]) + "\n"


def to_text(r: ExecResult) -> str:
    """Lines of cells joined by `` | ``."""
    return "\n".join(" | ".join("NULL" if v is None else str(v) for v in row) for row in ([tuple(r.columns), *r.rows] if r.columns else []))


def write_csv(df: DataFrame, folder: str, null: str = "") -> None:
    """CSV of any size, written by the executors."""
    df.write.mode("errorifexists").csv(folder, header=True, nullValue=null, emptyValue='""', escape='"')
