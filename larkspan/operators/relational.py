"""Operators on DataFrames. They only declare the plan: Catalyst and adaptive execution choose join strategy, pruning and partitions."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F


def vec_scan(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """Rows that are already there, as a relation."""
    return spark.createDataFrame(list(rows), schema)


def row_scan(spark: SparkSession, rows: Callable[[int], Iterable[tuple]], partitions: int, schema: str, batch: int = 2048) -> DataFrame:
    """Rows of a function that each task calls with its partition's number; they leave it in batches, so a source may be of any size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in b["id"]:
                source = iter(rows(int(part)))
                while got := list(itertools.islice(source, batch)):
                    yield pd.DataFrame(got, columns=names)

    names = T.StructType.fromDDL(schema).names
    return spark.range(0, partitions, 1, partitions).mapInPandas(run, schema)


def project(df: DataFrame, columns: Sequence[int | str | Column]) -> DataFrame:
    """Reorder, prune or compute columns; numbers are positions."""
    return df.select(*[df.columns[c] if isinstance(c, int) else c for c in columns])


def map_batches(df: DataFrame, transform: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A host function over batches of rows, for what columns cannot say."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield transform(b)

    return df.mapInPandas(run, schema)


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; UNKNOWN drops."""
    return df.filter(predicate)


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Left columns, then right columns. NULL keys never match. Column names of the sides must differ."""
    return left.join(right, left[left_key] == right[right_key], how)


def hash_aggregate(df: DataFrame, keys: Sequence[str | Column], aggregates: Sequence[Column]) -> DataFrame:
    """One row per key, NULL being a key; one row in all without keys, on empty input too. Partial sums form before the shuffle."""
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def ordering(col: Column, desc: bool = False) -> Column:
    """NULL is the largest value: last ascending, first descending."""
    return col.desc_nulls_first() if desc else col.asc_nulls_last()


def sort(df: DataFrame, keys: Sequence[tuple[Column, bool]]) -> DataFrame:
    """Order by (column, descending) pairs; with :func:`limit` Spark keeps only the top rows of each partition."""
    return df.orderBy(*[ordering(c, d) for c, d in keys])


def limit(df: DataFrame, n: int | None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if n is None else df.limit(n)


def set_operation(left: DataFrame, right: DataFrame, op: str, keep_all: bool = False) -> DataFrame:
    """UNION, INTERSECT or EXCEPT by position; ``keep_all`` keeps repeats."""
    right = right.toDF(*left.columns)
    if op == "UNION":
        return left.union(right) if keep_all else left.union(right).distinct()
    if op == "INTERSECT":
        return left.intersectAll(right) if keep_all else left.intersect(right)
    return left.exceptAll(right) if keep_all else left.subtract(right)


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
