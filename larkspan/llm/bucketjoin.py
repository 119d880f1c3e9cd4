"""Verified similarity join over hash buckets: no pair is emitted, counted twice or lost to a bucket's size.

Every item sits in some buckets. Two items of one bucket are compared there, unless an earlier bucket
also holds both: the pair belongs to its first common bucket, which both items' key lists tell. A bucket
of many items is cut into blocks, and each pair of blocks is a unit of work of its own, so that a
third of all rows in one bucket spreads over many tasks. A unit returns link counts for each item and
a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import materialize, release, shuffle_partitions

#: Items of a block, and payload units (as ``weight``) of a block.
BLOCK, BLOCK_WEIGHT = 256, 1_000_000


def live_buckets(entries: DataFrame) -> DataFrame:
    """``entries(kr, rep, weight)`` -> those of buckets with a pair, one bucket for each set of members.

    ``kr`` is a bucket's key (even) plus 1 where the item is at home; items that only probe a bucket
    are not compared with each other.
    """
    e = entries.withColumn("key", F.expr("kr - pmod(kr, 2)"))
    stats = e.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.max(F.expr("pmod(kr, 2)")).alias("home"),
        F.bit_xor(F.xxhash64("rep", F.expr("pmod(kr, 2)"))).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "rep", F.expr("pmod(kr, 2)"))).alias("h2"),
    ).where("n > 1 and home = 1")
    once = stats.groupBy("h1", "h2", "n").agg(F.min("key").alias("key"), F.max("w").alias("w"))
    return e.join(once.select("key", "n", "w"), "key").select("key", "kr", "rep", "n", "w")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as tables; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(b.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
        for s, e in zip(at, at[1:]):
            k = tuple(c[s] for c in cols)
            if held and k != last:
                yield pa.Table.from_batches(held)
                held = []
            last = k
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _earlier(krs: list[np.ndarray], key: int) -> np.ndarray:
    """Which pairs of items an earlier bucket than ``key`` compares."""
    g = len(krs)
    own = [k[k < key] for k in krs]
    who = np.repeat(np.arange(g), [len(k) for k in own])
    kr = np.concatenate(own) if own else np.zeros(0, np.int64)
    home = (kr & 1).astype(bool)
    uniq, inv, cnt = np.unique(kr & ~np.int64(1), return_inverse=True, return_counts=True)
    keep = cnt[inv] > 1
    who, home, inv = who[keep], home[keep], np.unique(inv[keep], return_inverse=True)[1]
    out = np.zeros((g, g), bool)
    for lo in range(0, (int(inv.max()) + 1) if len(inv) else 0, 4096):
        at = (inv >= lo) & (inv < lo + 4096)
        a = np.zeros((g, 4096), np.float32)
        a[who[at], inv[at] - lo] = 1
        h = np.zeros_like(a)
        h[who[at & home], inv[at & home] - lo] = 1
        c = h @ a.T
        out |= (c + c.T) > 0
    return out


def _forest(i: np.ndarray, j: np.ndarray, g: int) -> list[tuple[int, int]]:
    """Spanning forest of the links, by rounds of smallest neighbours (vectorised), as (item, root)."""
    root = np.arange(g)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        new = root.copy()
        np.minimum.at(new, root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new[root]
    return [(k, int(r)) for k, r in enumerate(root) if r != k]


def bucket_join(live: DataFrame, payload: DataFrame, verify: Callable[[list[bytes]], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """Link counts ``(rep, n_links)`` and forest edges ``(u, v)``.

    ``payload(rep, mult, data)``; ``mult`` is the number of rows that the item stands for. ``verify``
    gets the data of a block pair and returns a function of two index vectors that returns the matrix of links.
    """
    spark = live.sparkSession
    keys = live.groupBy("rep").agg(F.sort_array(F.collect_list("kr")).alias("krs"))
    full = keys.join(payload, "rep")
    nb = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / BLOCK_WEIGHT)).cast("int")
    spread = live.withColumn("nb", nb).withColumn("blk", F.expr("cast(pmod(xxhash64(rep, 3), nb) as int)"))
    spread = spread.select("key", "kr", "rep", "blk", F.explode(F.expr("sequence(0, nb - 1)")).alias("o"))
    spread = spread.select("key", F.expr("pmod(kr, 2)").cast("int").alias("home"), "rep", "blk", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"))
    rows = spread.join(full, "rep").select("key", "bi", "bj", "blk", "home", "rep", "mult", "krs", "data")
    rows = rows.repartition(shuffle_partitions(spark), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", "bi", "bj"]):
            if t.num_rows < 2:
                continue
            t = t.combine_chunks()
            key, bi, bj = (t.column(c)[0].as_py() for c in ("key", "bi", "bj"))
            rep, mult, blk, home = (t.column(c).to_numpy() for c in ("rep", "mult", "blk", "home"))
            link = verify(t.column("data").to_pylist())
            a = np.arange(len(rep)) if bi == bj else np.flatnonzero(blk == bi)
            b = a if bi == bj else np.flatnonzero(blk == bj)
            if not len(a) or not len(b):
                continue
            m = link(a, b) & (home[a][:, None] | home[b][None, :]).astype(bool)
            if bi == bj:
                m &= np.tri(len(a), k=-1, dtype=bool)
            if not m.any():
                continue
            x, y = np.nonzero(m)
            x, y = a[x], b[y]
            used = np.unique(np.concatenate([x, y]))
            kr = t.column("krs").combine_chunks()
            o, v = kr.offsets.to_numpy(), kr.values.to_numpy()
            krs = [v[o[k] : o[k + 1]] for k in used]
            px, py = np.searchsorted(used, x), np.searchsorted(used, y)
            first = ~_earlier(krs, key)[px, py]
            x, y = x[first], y[first]
            if not len(x):
                continue
            n = np.zeros(len(rep), np.int64)
            np.add.at(n, x, mult[y])
            np.add.at(n, y, mult[x])
            f = _forest(x, y, len(rep))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[at], rep[[k for k, _ in f]]])), pa.array([None] * len(at) + rep[[r for _, r in f]].tolist(), pa.int64()), pa.array(np.concatenate([n[at], np.zeros(len(f), np.int64)]))],
                ["u", "v", "n"],
            )

    found = materialize(rows.mapInArrow(run, "u long, v long, n long"), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n_links"))
    return counts, found.where("v is not null").select("u", "v")


__all__ = ["bucket_join", "live_buckets", "materialize", "release"]
