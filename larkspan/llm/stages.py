"""Pipeline stages on the columns of ``documents``: each applies an operator's decision to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from larkspan.llm.names import free_names
from larkspan.llm.scratch import materialize, shuffle_partitions


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Documents that the classifier chain, trained on ``labels``, finds toxic go."""
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = F.element_at(toxicity.toxicity_column(model, F.col("text").cast("string")), -1)
    return docs.where(p < threshold)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the last of them; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    bitmap = F.col(out.columns[-2])
    text = line_dedup.kept_text(F.col("text"), bitmap)
    columns = []
    for name in docs.columns:
        c = F.col(mixing.quoted(name))
        if name == "text":
            c = text
        elif name == "n_chars":
            c = F.when(bitmap.isNull(), c).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
        columns.append(c.alias(name))
    return out.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays.

    Where ids repeat, each text of an id is a document of its own (by a hash, in its order), and of rows equal in both one stays.
    Rows with a null id stay.
    """
    names = docs.columns
    gone, text_hash = free_names(names, "_gone", "_hash")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is not null and n > 1").isEmpty():
        lost = ngram_join.ngram_jaccard_join(docs.select("doc_id", "text")).where(~F.col("kept")).select(F.col("doc_id").alias(gone))
        return docs.join(lost, F.col("doc_id") == F.col(gone), "left_anti")
    docs = docs.withColumn(text_hash, F.xxhash64("text"))
    key = ["doc_id", "hash"]
    own = [F.col("doc_id"), F.col(text_hash).alias("hash")]
    rows = docs.where("doc_id is not null").select(*own).groupBy(*key).agg(F.count("*").alias("n"))
    # numbers in the order of id and hash
    rows = rows.repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions(*key).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "row_keys")
    found = ngram_join.ngram_jaccard_join(docs.select(*own, "text").join(rows, key).select("row", "text"), id_col="row").where(~F.col("kept"))

    def among(some: DataFrame, how: str, of: DataFrame) -> DataFrame:
        keys = some.select(F.col("doc_id").alias(gone), F.col("hash").alias(gone + "h"))
        return of.join(keys, (F.col("doc_id") == F.col(gone)) & (F.col(text_hash) == F.col(gone + "h")), how)

    left = among(rows.join(found, "row"), "left_anti", docs)
    repeated = rows.where("n > 1")
    once = among(repeated, "left_anti", left).select(*map(mixing.quoted, names))
    first = among(repeated, "left_semi", left).groupBy("doc_id", text_hash).agg(F.min(F.struct(*map(mixing.quoted, names))).alias(gone))
    return once.unionByName(first.select(F.col(f"{gone}.*")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1, a row for each time that the mix takes a document."""
    return mixing.mixed_documents(docs, (5, 2, 1), 3.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, token_ids)`` of each row."""
    import public_tokenizers

    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")
