"""Embedding near-dedup by lattice hashing.

Each table projects the unit vectors with a Gaussian matrix to one or more groups of 8 dimensions and decodes each group to the nearest point of the
E8 lattice; the points together name a cell. A vector is at home in its own cell and probes the neighbouring cells that lie
nearest to it. Vectors that meet in a cell are compared by exact cosine. How many groups make a cell, how fine the
lattice is, how many cells are probed and how many tables there are follows from the number of rows and the recall that is asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.bucketjoin import bucket_join, live_buckets
from larkspan.llm.components import connected_components
from larkspan.llm.scratch import materialize, release
from larkspan.llm.textkit import mix


def _d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    r = x - f
    rows = np.arange(len(x))
    worst = np.abs(r).argmax(1)
    g = f.copy()
    g[rows, worst] += np.where(r[rows, worst] >= 0, 1.0, -1.0)
    return np.where((f.sum(1) % 2 != 0)[:, None], g, f)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def e8_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


_NEAR = e8_neighbours()


@dataclass(frozen=True)
class Plan:
    """``codes`` lattice points name a cell, ``scale`` stretches the projections; ``tables`` tables with ``probes`` probed cells each."""

    codes: int
    scale: float
    probes: int
    tables: int


def cells(points: np.ndarray, probes: int) -> np.ndarray:
    """Doubled lattice points ``(row, 1 + probes, code, 8)`` of the cells nearest to ``points (row, code, 8)``, each row's own cell first."""
    rows, codes, _ = points.shape
    near, wide = _NEAR, 4 if codes > 1 else max(1, probes)
    c = decode_e8(points.reshape(-1, 8))
    side = (points.reshape(-1, 8) - c) @ near.T
    pick = np.argpartition(-side, wide - 1, axis=1)[:, :wide] if wide < 240 else np.argsort(-side, axis=1)
    # how much farther (in squared distance, halved) a neighbouring point is than the nearest one
    far = np.concatenate([np.zeros((len(c), 1)), 1.0 - np.take_along_axis(side, pick, 1)], axis=1).reshape(rows, codes, -1)
    options = np.concatenate([c[:, None, :], c[:, None, :] + near[pick]], axis=1).reshape(rows, codes, wide + 1, 8)
    combos = np.array(list(itertools.product(range(wide + 1), repeat=codes)))
    total = far[:, np.arange(codes), combos].sum(-1)  # the first combination is the vector's own cell, at no distance
    chosen = np.argsort(total[:, 1:], axis=1, kind="stable")[:, :probes] + 1
    chosen = combos[np.concatenate([np.zeros((rows, 1), int), chosen], axis=1)]
    out = options[np.arange(rows)[:, None, None], np.arange(codes), chosen]
    return np.rint(out * 2).astype(np.int64)


#: Numbers of probed cells that plans choose from.
PROBES = (4, 8, 16)


@cache
def recall_of(codes: int, scale: float, threshold: float, pairs: int = 2000) -> dict[int, float]:
    """For each of :data:`PROBES` the chance that a pair at ``threshold`` meets in one table, measured on pairs of projections: these are normal with that correlation."""
    rng = np.random.default_rng([codes, int(scale * 1000)])
    x = rng.standard_normal((pairs, codes, 8))
    y = threshold * x + np.sqrt(1 - threshold**2) * rng.standard_normal(x.shape)
    shift = rng.random((pairs, codes, 8))
    a, b = (cells(z * scale + shift, max(PROBES)) for z in (x, y))
    meet = (a == b[:, :1]).all((2, 3)) | (b == a[:, :1]).all((2, 3))
    return {p: float(meet[:, : p + 1].any(1).mean()) for p in PROBES}


@cache
def plan_tables(rows: int, threshold: float, miss: float, pair_cost: float = 12.0) -> Plan:
    """The cheapest plan with which ``rows`` rows lose a pair at ``threshold`` with a chance of ``miss``.

    The cost of a row is its cells and, at ``pair_cost`` cells each, the unrelated rows that it meets. Two unrelated vectors' projections differ by a normal vector of
    variance ``2 * scale**2``, so they share a lattice point with a chance of about ``(4 * pi * scale**2) ** -4`` in each group.
    """
    best, least = None, np.inf
    for codes, scale, probes in itertools.product((1, 2, 3), (0.6, 0.7, 0.85, 1.0), PROBES):
        found = recall_of(codes, scale, threshold)[probes]
        if found < 0.2:
            continue
        tables = max(1, int(np.ceil(np.log(miss) / np.log(max(1e-12, 1 - found)))))
        chance = min(1.0, (4 * np.pi * scale**2) ** -4.0) ** codes
        cost = tables * (1 + probes) + pair_cost * rows * tables * (1 + 2 * probes) * chance
        if cost < least:
            best, least = Plan(codes, scale, probes, tables), cost
    return best or Plan(1, 0.5, 16, 64)


def lattice_keys(unit: np.ndarray, labels: np.ndarray, plan: Plan, seed: int) -> np.ndarray:
    """Bucket keys of each vector, ``tables * (1 + probes)`` of them: even for a probe, odd at home."""
    rng = np.random.default_rng([seed, unit.shape[1], plan.codes])
    out = []
    for t in range(plan.tables):
        a, shift = rng.standard_normal((unit.shape[1], plan.codes * 8)), rng.random(plan.codes * 8)
        code = cells((unit @ a * plan.scale + shift).reshape(len(unit), plan.codes, 8), plan.probes).astype(np.uint64)
        h = np.broadcast_to(mix(labels.astype(np.uint64) + np.uint64(t * 0x9E3779B97F4A7C15 % 2**64))[:, None], code.shape[:2])
        for g in range(plan.codes):
            for d in range(8):
                h = mix(h ^ (code[:, :, g, d] + np.uint64(d)))
        k = (h & ~np.uint64(1)).view(np.int64).copy()
        k[:, 0] |= 1
        out.append(k)
    return np.concatenate(out, axis=1)


def _matrix(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows hold a usable vector, and the vectors of equal length together (as row numbers)."""
    ok = np.zeros(len(col), bool)
    by_len: dict[int, list[int]] = {}
    for i, v in enumerate(col):
        x = v.values if v.is_valid else None
        if x is None or not len(x) or x.null_count:
            continue
        a = x.to_numpy()
        if np.isfinite(a).all() and a.any():
            ok[i] = True
            by_len.setdefault(len(a), []).append(i)
    return ok, [np.array(r) for r in by_len.values()]


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98, miss: float = 1e-7, plan: Plan | None = None, seed: int = 17) -> DataFrame:
    """One row per id: ``(id, n_links, component_id, kept)``; no pair below ``threshold`` ever links.

    Vectors link only when their labels are equal and not null (``label_col=None``: always). A vector
    that is null, empty, all zero, or holds null or non-finite components links with nothing; so do
    vectors of different lengths. Rows with a null id are left out. Of rows that share an id, the
    one with the smallest (label, vector) counts. Equal vectors stand as one item with a multiplicity.
    Other columns are ignored. An empty table gives no rows.

    A pair at ``threshold`` is lost with a chance of about ``miss``, others with less. Unless ``plan`` is given, it follows from the number of
    rows of the most frequent label, so that the unrelated vectors that a vector meets do not grow with the table.
    """
    label = F.col(label_col).cast("long") if label_col else F.lit(0).cast("long")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    src = src.groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    src = materialize(src.withColumn("good", F.coalesce(usable, F.lit(False))).withColumn("f1", F.xxhash64("label", "v")).withColumn("f2", F.xxhash64(F.lit(5), "v", "label")), "vec")
    groups = src.where("good").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    reps = materialize(src.join(groups, ["f1", "f2"]).where("id = rep").select("rep", "mult", "label", "v"), "reps")

    if plan is None:
        rows = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        plan = plan_tables(1 << int(rows).bit_length(), threshold, miss)
    chosen = plan

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, lab = b.column("rep").to_numpy(), b.column("label").to_numpy()
            for rows in _matrix(b.column("v"))[1]:
                for part in np.array_split(rows, len(rows) // 1024 + 1):
                    if len(part):
                        x = np.vstack([b.column("v")[int(i)].values.to_numpy() for i in part])
                        x = x / np.abs(x).max(1)[:, None]
                        k = lattice_keys(x / np.linalg.norm(x, axis=1)[:, None], lab[part], chosen, seed)
                        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(rep[part], k.shape[1])), pa.array(np.ones(k.size, np.int64))], ["kr", "rep", "weight"])

    def verify(data: list[bytes]):
        raw = [np.frombuffer(d, np.float64) for d in data]
        width = max(map(len, raw))
        x = np.zeros((len(raw), width))
        for i, r in enumerate(raw):
            x[i, : len(r)] = r
        lab, x, size = x[:, 0], x[:, 1:], np.array([len(r) for r in raw])
        x = x / np.abs(x).max(1)[:, None]
        x = x / np.sqrt((x * x).sum(1))[:, None]
        return lambda a, b: (x[a] @ x[b].T >= threshold) & (lab[a][:, None] == lab[b][None, :]) & (size[a][:, None] == size[b][None, :])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.concatenate([[lab], v.values.to_numpy()]).astype(np.float64).tobytes() for lab, v in zip(b.column("label").to_numpy(), b.column("v"))]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("mult"), pa.array(data, pa.binary())], ["rep", "mult", "data"])

    entries = materialize(reps.mapInArrow(hashed, "kr long, rep long, weight long"), "cells")
    live = materialize(live_buckets(entries), "live")
    release(entries)
    counts, edges = bucket_join(live, reps.mapInArrow(packed, "rep long, mult long, data binary"), verify)
    release(live)
    release(reps)
    comp = connected_components(edges)
    rep_stats = groups.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    rep_stats = rep_stats.select("f1", "f2", (F.col("mult") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = src.where("good").select("id", "f1", "f2").join(rep_stats, ["f1", "f2"]).select("id", "n_links", "component_id")
    bad = src.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.union(bad)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
