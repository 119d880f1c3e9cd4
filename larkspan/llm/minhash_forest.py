"""An LSH forest of MinHash signatures: sorted tries whose matched prefixes are as long as the recall allows.

An item has one signature in each tree: some levels of a few bits, each from a minimum of its own. All signatures are sorted by tree
and level, so that a trie's node is a run of rows with one prefix. Going up from the longest prefix, an item's matched prefix is the shortest
whose node still has room for all its items, and no shorter than ``shortest``: sparse regions end there. Where nodes are crowded
prefixes stay longer, which loses recall; an item whose trees together fall short of the target shortens its longest prefixes, all trees
at once and level by level, until the target is met. What a node's items do, they all do, so two items meet in a node or not at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import materialize, release, shuffle_partitions
from larkspan.llm.textkit import mix

#: Bits of a level. ``hi`` holds the tree and the first four levels, ``lo`` the next four.
BITS, HALF = 14, 4
_COLUMNS = ["kind", "hi", "lo", "rep", "weight", "depth", "counts"]


def shortest_depth(threshold: float, trees: int, longest: int, recall: float) -> int:
    """The longest prefix at which ``trees`` trees reach ``recall`` for pairs at ``threshold``: no prefix need be shorter."""
    for d in range(longest, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def signatures(sets: list[np.ndarray], trees: int, longest: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hi, lo)`` of each set in each tree. Sets are not empty, their numbers are hashes."""
    flat = np.concatenate(sets)
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    mult = mix(np.arange(1, trees * longest + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)
    hi, lo = (np.zeros((len(sets), trees), np.int64) for _ in range(2))
    for t in range(trees):
        hi[:, t] = t << BITS * HALF
        for d in range(longest):
            level = (mix(np.minimum.reduceat(flat * mult[t * longest + d], off)) >> np.uint64(64 - BITS)).astype(np.int64)
            (hi if d < HALF else lo)[:, t] |= level << BITS * (HALF - 1 - d % HALF)
    return hi, lo


def _cut(hi: np.ndarray, lo: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    return (hi, lo >> BITS * (2 * HALF - depth)) if depth > HALF else (hi >> BITS * (HALF - depth), np.zeros_like(lo))


def prefix(hi: Column, lo: Column, depth: Column) -> tuple[Column, Column]:
    """A node's name: the signature cut to ``depth`` levels."""
    shift = lambda c, n: F.call_function("shiftright", c, n.cast("int"))
    return F.when(depth > HALF, hi).otherwise(shift(hi, BITS * (HALF - depth))), F.when(depth > HALF, shift(lo, BITS * (2 * HALF - depth))).otherwise(F.lit(0).cast("long"))


def matched_prefixes(entries: DataFrame, shortest: int, longest: int, room: int) -> DataFrame:
    """``entries(hi, lo, rep, weight)`` -> those with a ``depth``, the length of the matched prefix, before any recall is looked at.

    Items alone in their node at ``shortest`` levels match nothing and are left out. The sorted rows are streamed: whether a node
    has room takes ``room`` rows ahead and behind. Nodes that touch a partition's edge are settled by adding up the edges: some ``room`` rows and a
    few nodes per edge.
    """
    levels = list(range(shortest, longest + 1))
    ranged = entries.repartitionByRange(shuffle_partitions(entries.sparkSession), "hi", "lo", "rep").sortWithinPartitions("hi", "lo", "rep")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cols: list[np.ndarray], first: int, last: int, opens: bool, closes: bool) -> Iterator[pa.RecordBatch]:
            """Rows ``first`` to ``last`` of a window whose other rows are only looked at."""
            hi, lo, rep, weight = cols
            n = len(hi)
            if not n:
                return
            counts, sure = np.zeros((n, len(levels)), np.int32), np.ones((n, len(levels)), bool)
            edges: list[tuple[int, int, int, int]] = []
            for j, d in enumerate(levels):
                p, q = _cut(hi, lo, d)
                new = np.ones(n, bool)
                new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
                run = np.cumsum(new) - 1
                size = np.minimum(np.bincount(run), room + 1)
                touch = np.zeros(len(size), bool)
                touch[0], touch[-1] = opens, closes or (opens and len(size) == 1)
                counts[:, j], sure[:, j] = size[run], (~touch | (size > room))[run]
                if opens:
                    edges.append((d, int(p[0]), int(q[0]), int(size[0])))
                if closes and not (opens and len(size) == 1):
                    edges.append((d, int(p[-1]), int(q[-1]), int(size[-1])))
            fits = (counts <= room) & sure
            fits[:, -1] |= sure[:, -1]  # the longest prefix is the last resort
            first_fit, first_doubt = fits.argmax(1), np.where(sure.all(1), len(levels), (~sure).argmax(1))
            settled = fits.any(1) & (first_fit < first_doubt)
            at = np.arange(first, last)
            depth = np.where(settled, np.array(levels)[first_fit], 0)
            alone = settled & (first_fit == 0) & (counts[:, 0] == 1)
            at = at[~alone[at]]
            if len(at):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(levels)), pa.array(counts[at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(settled[at], 0, 1).astype(np.int32)), *(pa.array(c[at]) for c in cols), pa.array(depth[at].astype(np.int32)), lists], _COLUMNS)
            if edges:
                d, p, q, k = zip(*edges)
                zero = pa.array([0] * len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([2] * len(d), pa.int32()), pa.array(p, pa.int64()), pa.array(q, pa.int64()), zero, zero, pa.array(d, pa.int32()), pa.array([[x] for x in k], pa.list_(pa.int32()))], _COLUMNS)

        ahead = room + 1
        cols, done, opens = [np.zeros(0, np.int64)] * 4, 0, True
        for b in batches:
            cols = [np.concatenate([c, b.column(k).to_numpy()]) for c, k in zip(cols, ("hi", "lo", "rep", "weight"))]
            last = len(cols[0]) - ahead
            if last - done < 2 * ahead:
                continue
            yield from found(cols, done, last, opens, False)
            opens, keep = False, max(0, last - ahead)
            cols, done = [c[keep:] for c in cols], last - keep
        yield from found(cols, done, len(cols[0]), opens, True)

    out = materialize(ranged.mapInArrow(stream, "kind int, hi long, lo long, rep long, weight long, depth int, counts array<int>"), "trie")
    totals = out.where("kind = 2").groupBy("hi", "lo", "depth").agg(F.sum(F.col("counts")[0]).alias("total"))
    totals = totals.select(F.col("hi").alias("p"), F.col("lo").alias("q"), F.col("depth").alias("d"), "total")
    open_ = out.where("kind = 1").select("hi", "lo", "rep", "weight", F.posexplode("counts").alias("j", "here")).withColumn("d", F.col("j") + shortest)
    p, q = prefix(F.col("hi"), F.col("lo"), F.col("d"))
    open_ = open_.withColumn("p", p).withColumn("q", q).join(totals, ["p", "q", "d"], "left").withColumn("n", F.coalesce("total", "here"))
    late = open_.groupBy("hi", "lo", "rep", "weight").agg(F.min(F.when(F.col("n") <= room, F.col("d"))).alias("fit"), F.max(F.when(F.col("d") == shortest, F.col("n"))).alias("n"))
    late = late.where("n > 1").select("hi", "lo", "rep", "weight", F.coalesce("fit", F.lit(longest)).cast("int").alias("depth"))
    matched = materialize(out.where("kind = 0").select("hi", "lo", "rep", "weight", "depth").union(late), "matched")
    release(out)
    return matched


def forest(entries: DataFrame, trees: int, longest: int, threshold: float, recall: float, room: int = 64) -> DataFrame:
    """``(hi, lo, rep, weight, depth)``: the nodes in which items are to be compared, see the module's text. Items that match nothing are left out."""
    shortest = shortest_depth(threshold, trees, longest, recall)
    matched = matched_prefixes(entries, shortest, longest, room)
    gain = {d: -math.log1p(-(threshold**d)) for d in range(shortest, longest + 1)}  # of a prefix of d levels, in logarithms of the chance to miss a pair
    worth = F.create_map(*[F.lit(x) for d, g in gain.items() for x in (d, g)])
    crowded = matched.where(F.col("depth") > shortest)
    # trees that are not crowded match at the shortest prefix, or alone
    each = crowded.groupBy("rep").agg(F.collect_list("depth").alias("ds"), F.max("depth").alias("top"))
    cap = F.lit(shortest)
    for level in range(shortest + 1, longest + 1):
        total = F.aggregate("ds", F.lit(0.0), lambda s, d: s + F.element_at(worth, F.least(d, F.lit(level))))
        cap = F.when(total + (trees - F.size("ds")) * F.lit(gain[shortest]) >= -math.log1p(-recall), F.lit(level)).otherwise(cap)
    short = materialize(each.withColumn("cap", cap).where("cap < top").select("rep", "cap"), "short")
    if short.isEmpty():
        return matched
    p, q = prefix(F.col("hi"), F.col("lo"), F.col("d"))
    asked = crowded.join(short, "rep").where("depth > cap").withColumn("d", F.col("cap")).select(p.alias("p"), q.alias("q"), "d").distinct()
    above = crowded.withColumn("d", F.explode(F.sequence(F.lit(shortest), F.col("depth") - 1))).withColumn("p", p).withColumn("q", q)
    cut = above.join(asked, ["p", "q", "d"]).groupBy("hi", "lo", "rep").agg(F.min("d").alias("cut"))
    moved = matched.join(cut, ["hi", "lo", "rep"], "left").select("hi", "lo", "rep", "weight", F.coalesce("cut", "depth").alias("depth"))
    return moved


def buckets(found: DataFrame) -> DataFrame:
    """``(kr, rep, weight)`` for :mod:`larkspan.llm.bucketjoin`: every item is at home in its node."""
    p, q = prefix(F.col("hi"), F.col("lo"), F.col("depth"))
    return found.select(F.xxhash64(p, q, "depth").bitwiseOR(F.lit(1)).alias("kr"), "rep", "weight")
