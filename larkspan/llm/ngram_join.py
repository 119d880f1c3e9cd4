"""N-gram Jaccard self-join: a MinHash LSH forest finds candidates, shingle sets verify them.

The forest (:mod:`larkspan.llm.minhash_forest`) keeps signatures as sorted tries and shortens matched prefixes until the recall
is met; items that meet in a node are compared by their sets of shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.bucketjoin import bucket_join, live_buckets
from larkspan.llm.components import connected_components
from larkspan.llm.minhash_forest import buckets, forest, signatures
from larkspan.llm.scratch import materialize, release
from larkspan.llm.textkit import mix, shingles, slices


def _sets(col: pa.Array, n: int) -> list[np.ndarray]:
    sh, off = shingles(col, n)
    return [np.unique(sh[a:b]) for a, b in zip(off, off[1:])]


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    cum = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(k)), dtype=np.uint64)]) for k in (11, 29)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return tuple(mix(c[off[1:]] - c[off[:-1]]).view(np.int64) for c in cum)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, trees: int = 20, longest: int = 6, recall: float = 0.9999, room: int = 64, seed: int = 3) -> DataFrame:
    """One row per id: ``(id, n_links, class_id, kept)``.

    Two documents link when their sets of ``n``-word shingles have a Jaccard similarity of at least
    ``threshold``; ``n_links`` counts the linked documents, ``class_id`` is the smallest id reachable by links and
    ``kept`` marks it. Words are runs of letters, digits and non-ASCII characters in lower case.
    Shorter texts are one shingle; texts without words (null, empty, blanks) link with nothing. Rows with a null id
    are left out; of rows that share an id, the one with the smallest shingle fingerprint counts.
    Candidates come from a forest of ``trees`` tries of ``longest`` levels, which finds a pair at ``threshold`` with a chance of
    ``recall`` or more; longer prefixes are matched where nodes hold more than ``room`` documents. Documents with equal sets stand as
    one item with a multiplicity. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = _sets(b.column("text"), n)
                f1, f2 = _fingerprints(sets)
                size = np.array([len(s) for s in sets], np.int64)
                has = np.flatnonzero(size)
                hi, lo = signatures([sets[i] for i in has], trees, longest, seed) if len(has) else (np.zeros((0, trees), np.int64),) * 2
                width = np.zeros(len(sets) + 1, np.int32)
                width[has + 1] = trees
                offsets = pa.array(np.cumsum(width, dtype=np.int32))
                keys = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (hi, lo)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(f1), pa.array(f2), pa.array(size), *keys], ["id", "f1", "f2", "size", "hi", "lo"])

    sig = materialize(src.mapInArrow(signed, "id long, f1 long, f2 long, size long, hi array<long>, lo array<long>"), "sig")
    one = sig.groupBy("id").agg(F.min(F.struct("f1", "f2", "size")).alias("s")).select("id", "s.*")
    one = materialize(one, "docs")
    groups = materialize(one.where("size > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.min("size").alias("size")), "groups")
    chosen = groups.select(F.col("rep").alias("id"), "f1", "f2", F.col("size").alias("weight"))
    entries = materialize(sig.join(chosen, ["id", "f1", "f2"]).dropDuplicates(["id"]).select(F.col("id").alias("rep"), "weight", F.explode(F.arrays_zip("hi", "lo")).alias("s")).select("s.hi", "s.lo", "rep", "weight"), "entries")
    found = forest(entries, trees, longest, threshold, recall, room)
    release(sig, entries)
    live = materialize(live_buckets(buckets(found)), "live")
    wanted = live.select("rep").distinct().join(groups, "rep").select(F.col("rep").alias("id"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), "mult")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = _sets(b.column("text"), n)
                f1, f2 = _fingerprints(sets)
                ok = np.flatnonzero((f1 == b.column("g1").to_numpy()) & (f2 == b.column("g2").to_numpy()))
                yield pa.RecordBatch.from_arrays([b.column("id").take(ok), b.column("mult").take(ok), pa.array([sets[i].tobytes() for i in ok], pa.binary())], ["rep", "mult", "data"])

    payload = src.join(wanted, "id").mapInArrow(packed, "rep long, mult long, data binary").dropDuplicates(["rep"])

    def verify(data: list[bytes]):
        return shared_sets([np.frombuffer(d, np.uint64) for d in data], threshold)

    counts, edges = bucket_join(live, payload, verify)
    release(live)
    comp = connected_components(edges)
    stats = groups.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    stats = stats.select("f1", "f2", (F.col("mult") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    some = one.where("size > 0").select("id", "f1", "f2").join(stats, ["f1", "f2"]).select("id", "n_links", "class_id")
    none = one.where("size = 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"))
    return some.union(none).select(F.col("id").alias(id_col), "n_links", "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def shared_sets(sets: list[np.ndarray], threshold: float):
    """A function of two index vectors: which pairs of sets have a Jaccard similarity of at least ``threshold``."""
    size = np.array([len(s) for s in sets], np.float64)

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a if len(a) == len(b) and (a == b).all() else np.concatenate([a, b])
        if len(both) <= 3:
            hit = np.array([[float(len(np.intersect1d(sets[i], sets[j], assume_unique=True))) for j in b] for i in a])
        else:
            flat = np.concatenate([sets[i] for i in both])
            who = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])
            _, inv, cnt = np.unique(flat, return_inverse=True, return_counts=True)
            keep = cnt[inv] > 1
            who, inv = who[keep], np.unique(inv[keep], return_inverse=True)[1]
            order = np.argsort(inv, kind="stable")
            who, inv = who[order], inv[order]
            hit = np.zeros((len(a), len(b)))
            na = len(a)
            for lo in range(0, int(inv[-1]) + 1 if len(inv) else 0, 4096):
                s, e = np.searchsorted(inv, [lo, lo + 4096])
                m = np.zeros((len(both), 4096), np.float32)
                m[who[s:e], inv[s:e] - lo] = 1
                hit += m[:na] @ (m if both is a else m[na:]).T
        union = size[a][:, None] + size[b][None, :] - hit
        return hit >= threshold * union - 1e-9

    return pairs
