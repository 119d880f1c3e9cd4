"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, most_bytes: int, seed: int = 1) -> DataFrame:
    """``docs`` and the other columns of ``labels``, for at most ``most`` labels and ``most`` rows: those whose ids hash smallest, as long as
    their texts come to ``most_bytes`` bytes at most. Texts of more than a sixteenth of that are left out.

    The chosen labels and rows are bounded, so they may be broadcast whatever the input's size. Of labels that share an id the
    smallest row counts; equal rows count once.
    """
    order = F.xxhash64("i", F.lit(seed))
    names = [c for c in labels.columns if c != id_col]
    one = labels.select(F.col(id_col).alias("i"), F.struct(*names).alias("label")).where("i is not null").groupBy("i").agg(F.min("label").alias("label"))
    picked = one.orderBy(order, "i").limit(most)
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0))
    rows = docs.select(F.col(id_col).alias("i"), F.struct(*docs.columns).alias("doc"), size.cast("long").alias("size"), F.xxhash64(*docs.columns).alias("h"))
    found = rows.join(F.broadcast(picked), "i")
    few = found.where(F.col("size") <= most_bytes // 16).select("i", "h", "size").distinct().orderBy(order, "i", "h").limit(most)
    fit = few.withColumn("run", F.sum("size").over(Window.orderBy(order, "i", "h"))).where(F.col("run") <= most_bytes).select("i", "h")
    return found.join(F.broadcast(fit), ["i", "h"]).dropDuplicates(["i", "h"]).select("doc.*", *[F.col(f"label.{c}") for c in names])
