"""From raw documents to token ids: five operators in a row, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import scratch, stages

#: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("ngram_join", stages.drop_near_duplicates),
    ("mix_sources", stages.mix),
    ("bpe", stages.encode),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            scratch.release(before)
        before = docs
    return docs
