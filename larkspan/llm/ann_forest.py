"""Approximate nearest neighbours by inner product: a forest of sorted hash strings.

The indexed vectors are dealt to shards of bounded size. In a shard each tree holds every vector's string of sign bits, sorted. A query
descends all trees together, as long as the nodes that it matches hold enough rows, then ascends one bit at a time until
enough different candidates stand below them; these are scored exactly. How many are enough is measured on a sample.

Signs of random projections tell angles. Vectors get one more coordinate, which lifts all of them to the length of the longest, so that the order of angles
to a query is the order of inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.scratch import materialize, release, shuffle_partitions


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """``x`` scaled by ``longest``, and the coordinate that makes unit vectors of them."""
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))])


class Forest:
    """Sorted hash strings of one shard."""

    def __init__(self, x: np.ndarray, longest: float, trees: int = 32, bits: int = 32, seed: int = 11):
        rng = np.random.default_rng([seed, x.shape[1]])
        self.bits, self.n = bits, len(x)
        self.planes = rng.standard_normal((trees, x.shape[1] + 1, bits))
        self.order, self.codes = [], []
        up = lift(x, longest)
        for p in self.planes:
            c = self._strings(up, p)
            o = np.argsort(c, kind="stable")
            self.order.append(o)
            self.codes.append(c[o])

    def _strings(self, x: np.ndarray, plane: np.ndarray) -> np.ndarray:
        return ((x @ plane) > 0).astype(np.int64) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def candidates(self, q: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows below the nodes that it matches, all trees at the deepest level at which there are ``least`` (or all) of them."""
        flat = np.column_stack([q, np.zeros(len(q))])
        codes = [self._strings(flat, p) for p in self.planes]
        lo, hi, spans = [], [], []
        for level in range(self.bits + 1):
            drop = self.bits - level
            base = [(c >> drop) << drop for c in codes]
            lo.append(np.array([np.searchsorted(s, b) for s, b in zip(self.codes, base)]))
            hi.append(np.array([np.searchsorted(s, b + (1 << drop)) for s, b in zip(self.codes, base)]))
            spans.append((hi[-1] - lo[-1]).sum(0))
            if (spans[-1] < least).all():
                break
        for k in range(len(q)):
            # fewer than ``least`` entries in all trees cannot be ``least`` rows
            level = max([j for j, s in enumerate(spans) if s[k] >= least], default=0)
            while True:
                seen = np.zeros(self.n, bool)
                for t in range(len(self.planes)):
                    seen[self.order[t][lo[level][t, k] : hi[level][t, k]]] = True
                found = np.flatnonzero(seen)
                if len(found) >= least or not level:
                    yield found
                    break
                level -= 1

    def nearest(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(ids, scores)`` of each query's ``k`` best candidates, best first, ties to the smaller id; ``own`` ids are no candidates."""
        many = 8 * least > self.n
        table = x @ q.T if many else None  # where most rows are candidates one product scores them all
        for j, cand in enumerate(self.candidates(q, least)):
            cand = cand[ids[cand] != own[j]]
            rough = table[cand, j] if many else x[cand] @ q[j]
            if len(cand) > k:
                # a product of matrices rounds otherwise than the score itself: what is as good but for rounding stays
                cut = np.partition(rough, len(rough) - k)[len(rough) - k]
                cand = cand[rough >= cut - 1e-9 * (1.0 + np.abs(rough).max())]
            score = np.array([float(np.dot(x[i], q[j])) for i in cand])
            best = np.lexsort((ids[cand], -score))[:k]
            yield ids[cand[best]], score[best]


#: Numbers of candidates that are tried on the sample.
LADDER = (50, 100, 200, 400, 800, 1600, 2400, 3200, 4000, 4800, 5600, 6400, 7200, 8192, 10240, 12288, 16384)


def enough(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, longest: float, k: int, target: float, **forest) -> int:
    """The least number of candidates at which the ``k`` nearest of the rows ``x`` are found with a recall of ``target``, over the queries."""
    if not len(q) or len(x) <= k:
        return len(x)
    f = Forest(x, longest, **forest)
    want = [set(i.tolist()) for i, _ in f.nearest(x, ids, q, own, k, len(x))]
    for least in LADDER:
        if least >= len(x):
            break
        hit = sum(len(w & set(i.tolist())) for w, (i, _) in zip(want, f.nearest(x, ids, q, own, k, least)))
        if hit >= target * sum(map(len, want)):
            return least
    return len(x)


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", least: int | None = None, target: float = 0.96, shard_rows: int = 16384, sample_queries: int = 128, sample_bytes: int = 1 << 24, seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found for each query, ties to the smaller id.

    Every row of ``vectors`` is indexed; a query's own id is no candidate. Scores are inner products of the vectors as they are, in
    double precision. A query looks at ``least`` rows of each shard. Unless given, that is the least number with which ``sample_queries`` queries find
    ``target`` of their nearest in one shard (of ``sample_bytes`` bytes at most): a shard's part of the ``k``, but two at least. It does not grow with the
    table. Vectors without any cluster structure, as independent Gaussian ones, have no near neighbours that a hash could single
    out, and need a third of a shard; clustered data do with a few hundred rows.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, neither do those of
    a length other than the query's. Rows with a null id are left out; of rows that share an id the smallest vector counts.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("v")
        ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null").where(ok)
        return df.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    base, asked = materialize(clean(vectors), "base"), materialize(clean(queries), "asked")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n_base, longest, widest = base.agg(F.count("*"), F.max(norm), F.max("dim")).first()
    n_asked = asked.count()
    longest = longest if longest and np.isfinite(longest) else 1.0
    shards = max(1, -(-n_base // shard_rows))
    shard = F.expr(f"cast(pmod(xxhash64(id), {shards}) as int)")
    if least is None:
        rows = min(shard_rows, max(k + 1, sample_bytes // (8 * (widest or 1))))
        top = lambda df, n: df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).toPandas()
        some, part = top(asked, sample_queries), top(base.where(shard == 0), rows)
        dim = int(part["dim"].mode()[0]) if len(part) else 0
        some, part = some[some["dim"] == dim], part[part["dim"] == dim]
        stack = lambda df: np.vstack(df["v"].tolist()) if len(df) else np.zeros((0, dim))
        least = enough(stack(part), part["id"].to_numpy(np.int64), stack(some), some["id"].to_numpy(np.int64), longest, max(2, -(-k // shards)), target)
        # a smaller sample than a shard stands for the same share of it
        least = max(k, least if len(part) >= min(n_base, shard_rows) // shards else -(-least * shard_rows // max(1, len(part))))
    need = least
    # a stated query set against all rows: a shard's forest is built once, and again only where there are fewer shards than tasks
    blocks = max(1, min(-(-shuffle_partitions(spark) // shards), -(-n_asked // 1024)))
    left = base.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("side"), "id", "dim", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.expr(f"cast(pmod(xxhash64(id, 1), {blocks}) as int)").alias("block"), F.lit(1).alias("side"), "id", "dim", "v")
    pairs = left.union(right).repartition(max(shuffle_partitions(spark), shards * blocks), "shard", "block").sortWithinPartitions("shard", "block", "dim", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard are held, queries pass by."""
        place, held, forest, x, ids = None, [], None, None, None
        for b in batches:
            key = [b.column(c).to_numpy() for c in ("shard", "block", "dim", "side")]
            cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in key])) + 1 if b.num_rows else []
            for s, e in zip([0, *cut], [*cut, b.num_rows]):
                if s == e:
                    continue
                now, side, dim, part = tuple(int(c[s]) for c in key[:3]), key[3][s], int(key[2][s]), b.slice(s, e - s)
                if now != place:
                    place, held, forest = now, [], None
                if side == 0:
                    held.append((part.column("id").to_numpy(), _vectors(part.column("v"), dim)))
                    continue
                if not held:
                    continue
                if forest is None:
                    ids, x = (np.concatenate(c) for c in zip(*held))
                    forest = Forest(x, longest, seed=seed)
                q, own = _vectors(part.column("v"), dim), part.column("id").to_numpy()
                for at in range(0, len(q), 512):
                    got = list(forest.nearest(x, ids, q[at : at + 512], own[at : at + 512], k, min(len(x), need)))
                    found, score = (np.concatenate(c) for c in zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[at : at + 512], [len(i) for i, _ in got])), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    found = materialize(pairs.mapInArrow(run, "query_id long, vec_id long, score double"), "found")
    release(base, asked)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
