"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it.

They lie in a folder of the application's own under ``spark.checkpoint.dir``, which the driver removes when it ends. Only where that
setting is unset, and the master is local (tests), a temporary folder stands in for it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder; the JVM deletes it on its way out."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = f"file://{tempfile.gettempdir()}"
        _own[app] = f"{named.rstrip('/')}/larkspan-{app}-{uuid.uuid4().hex[:8]}"
        fs, p = _hadoop(spark, _own[app])
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; a lost executor loses none of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads; what a result still reads goes with the application's folder."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            fs, p = _hadoop(df.sparkSession, path)
            fs.delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
