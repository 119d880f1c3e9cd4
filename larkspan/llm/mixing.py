"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Complete epochs of a source come first. What is left of its target is filled by documents in the order of
exponential keys (-ln u / quality), skipping those that do not fit, by prefix sums of sizes over ranges of (source, key): a source may
span any number of ranges, and each source's answer is a few runs of keys, each with a largest size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.names import free_names
from larkspan.llm.scratch import materialize, release, shuffle_partitions
from larkspan.llm.textkit import size_and_prose, slices

RUNS = "array<struct<above: double, upto: double, most: double>>"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality_col: str | None = None, seed: int = 7) -> DataFrame:
    """``docs`` as ``(id, source, size, key)``: size in ``[^\\x20\\x09-\\x0D]+`` matches, key exponential with the document's quality as rate.

    Quality is ``quality_col``, as a classifier's score, or else the share of the text's bytes that belong to words or ASCII blanks; 0.05 at least, and
    where it is null. The key follows from id, text and quality alone, so reruns agree, and rows equal in these share a key.
    """
    quality = F.col(quality_col).cast("double") if quality_col else F.lit(None).cast("double")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), quality.alias("quality"))
    src = src.withColumn("e", _exponential(F.col("id"), F.col("text"), seed))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                size, prose = size_and_prose(b.column("text"))
                rate = b.column("quality").to_numpy(zero_copy_only=False) if quality_col else prose
                key = b.column("e").to_numpy() / np.fmax(0.05, rate)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(size), pa.array(key)], ["id", "source", "size", "key"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(measured, f"id {kind}, source string, size long, key double")


def _exponential(id_: Column, text: Column, seed: int) -> Column:
    u = (F.xxhash64(id_, text, F.lit(seed).cast("long")).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u)


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """``(source, weight)``: sources by code point, null last, weigh as ``cycle`` repeats."""
    spark = sources.sparkSession
    ranged = sources.select("source").distinct().repartitionByRange(shuffle_partitions(spark), F.asc_nulls_last("source")).withColumn("pid", F.spark_partition_id())
    ranged = materialize(ranged, "sources")
    before = ranged.groupBy("pid").count().withColumn("before", F.sum("count").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    n = F.row_number().over(Window.partitionBy("pid").orderBy(F.asc_nulls_last("source"))) - 1 + F.coalesce("before", F.lit(0))
    at = ranged.join(before, "pid").select("source", n.alias("n"))
    return at.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod("n", F.lit(len(cycle))) + 1).cast("int")).alias("weight"))


def source_targets(sizes: DataFrame, weights: DataFrame, total: float | None = None, most: float = 3.0) -> DataFrame:
    """``(source, source_size, target)``: ``total`` shared by weight, a target stopping at ``most`` times its source's size.

    The excess of stopped sources is shared among the others by weight until none is above. Sources without a weight get nothing.
    ``total`` is the sum of all sizes unless given.
    """
    t = sizes.alias("s").join(weights.alias("w"), F.expr("s.source <=> w.source"), "left").select("s.source", "s.source_size", F.coalesce("w.weight", F.lit(0.0)).alias("weight"))
    t = materialize(t, "targets")
    goal = float(t.agg(F.sum("source_size")).first()[0] or 0) if total is None else float(total)
    level, stopped_before = 0.0, -1
    cap = F.col("source_size") * most
    while True:
        over = (F.col("weight") * level > cap) & (F.col("weight") > 0)
        full, weight, stopped = t.where("weight > 0").agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if stopped == stopped_before or not weight:
            if not weight:
                level = float("inf")
            break
        level, stopped_before = max(level, (goal - (full or 0.0)) / weight), stopped
    target = F.when(F.col("weight") > 0, F.least(cap, F.col("weight") * F.lit(level)) if level != float("inf") else cap).otherwise(F.lit(0.0))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def _untaken(groups: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    """The documents ``(source, pid, key, size)`` that ``plan`` does not take, with ``columns`` of it."""
    both = groups.alias("g").join(plan.alias("t"), F.expr("g.source <=> t.source"))
    return both.where("not array_contains(forced, key) and not exists(runs, x -> key > x.above and key <= x.upto and size <= x.most)").select("g.source", "pid", "key", "size", *columns)


def _walk(t):  # type: ignore[no-untyped-def]
    """One range in key order: a document is taken when it fits. A run ends at a document that fitted when the run began."""
    import pandas as pd

    t = t.sort_values("key", kind="stable")
    gap, most, above, upto = (t[c].iloc[0] for c in ("left", "most", "above", "upto"))
    done = []
    for key, size in zip(t["key"], t["size"]):
        if size <= gap:
            gap, upto = gap - size, key
        elif size <= most:
            done.append({"above": above, "upto": upto, "most": most})
            above, most = upto, gap
    if upto > above:
        done.append({"above": above, "upto": upto, "most": most})
    return pd.DataFrame({"source": [t["source"].iloc[0]], "left": [gap], "more": [done]})


def _fill(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """Go through each source's documents in key order and take those that fit what is left of ``gap``.

    A round takes whole ranges up to the one that the gap ends in, and walks through that one; later ranges are left to the next round.
    """
    names = plan.columns
    plan = plan.withColumn("at", F.lit(-1))
    while True:
        able = groups.alias("g").join(plan.alias("t"), F.expr("g.source <=> t.source")).where("pid > at and size <= gap and not array_contains(forced, key)")
        parts = able.groupBy("g.source", "pid").agg(F.sum("size").alias("part"), F.max("key").alias("last"), F.max("gap").alias("gap"))
        parts = parts.withColumn("run", F.sum("part").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)))
        ends = parts.groupBy("source").agg(F.expr("min(pid) filter (where run > gap)").alias("cross"), F.expr("max(run) filter (where run <= gap)").alias("got"), F.expr("max(last) filter (where run <= gap)").alias("last"))
        ends = materialize(ends, "ends")
        more = not ends.where("cross is not null").isEmpty()
        step = plan.alias("t").join(ends.alias("e"), F.expr("t.source <=> e.source"), "left").select("t.*", "cross", "got", "last", F.expr("if(size(runs) > 0, runs[size(runs) - 1].upto, -1D)").alias("above"))
        step = step.withColumn("left", F.expr("gap - coalesce(got, 0)"))
        if more:
            inside = groups.alias("g").join(step.alias("t"), F.expr("g.source <=> t.source and g.pid = t.cross")).where("g.size <= gap and not array_contains(forced, key)")
            inside = inside.select("g.source", "key", "g.size", "left", F.col("gap").alias("most"), "above", F.coalesce("last", "above").alias("upto"))
            walked = inside.groupBy("source").applyInPandas(_walk, f"source string, left double, more {RUNS}")
            step = step.alias("t").join(walked.alias("w"), F.expr("t.source <=> w.source"), "left").select("t.*", F.col("w.left").alias("then"), "more")
        else:
            step = step.withColumn("then", F.lit(None).cast("double")).withColumn("more", F.lit(None).cast(RUNS))
        whole = f"if(last is null, cast(array() as {RUNS}), array(named_struct('above', above, 'upto', last, 'most', gap)))"
        runs_now = F.expr(f"concat(runs, coalesce(more, {whole}))")
        step = step.withColumn("runs", runs_now).withColumn("gap", F.coalesce("then", "left")).withColumn("at", F.coalesce("cross", F.lit(2**31 - 1)))
        plan = materialize(step.select(*names, "at"), "plan")
        release(ends)
        if not more:
            return plan.drop("at")


def _close(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``closing``, the key of the document that goes over the target but nearer to it, and ``miss``. Every other document is longer than the gap."""
    one = _untaken(groups, plan.where("gap > 0"), "gap").where("size < 2 * gap").groupBy("source").agg(F.min(F.struct("size", "key")).alias("x"))
    both = plan.alias("t").join(one.alias("o"), F.expr("t.source <=> o.source"), "left")
    return materialize(both.select("t.*", F.col("x.key").alias("closing"), F.abs(F.col("gap") - F.coalesce("x.size", F.lit(0))).alias("miss")), "closed")


def cutoffs(rows: DataFrame, targets: DataFrame, near: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """``(source, source_size, target, epochs, runs, extra)`` and ``(source, key)`` of exceptions: what the whole passes and the last, partial one take.

    The partial pass goes through all documents in key order and skips only those that do not fit what is left. A document of size up to
    ``most`` with a key in ``(above, upto]`` of a run is taken, so are the keys in ``extra``. Rows that share a key are one document;
    exceptions are those too long together, though one row is not. A source that stays off its target by more than the share ``near``, since all
    that fits is taken, begins anew with a skipped document ahead of the others, as long as that brings it nearer.
    """
    spark = rows.sparkSession
    groups = rows.groupBy("source", "key").agg(F.sum("size").alias("size"), F.max("size").alias("one")).where("size > 0")
    groups = materialize(groups.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_last("source"), "key").withColumn("pid", F.spark_partition_id()), "ranged")
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("gap", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("room", F.col("gap")).withColumn("runs", F.expr(f"cast(array() as {RUNS})")).withColumn("forced", F.array().cast("array<double>"))
    names = plan.columns
    best = _close(groups, _fill(groups, plan)).withColumn("open", F.lit(True))
    while True:
        off = best.where(F.col("open") & (F.col("room") > 0) & (F.col("miss") > near * F.col("target")))
        # the first in key order of those that would fit an empty partial pass, else the shortest
        ahead = _untaken(groups, off, "room").groupBy("source").agg(F.expr("min(struct(key, size)) filter (where size <= room)").alias("fits"), F.min(F.struct("size", "key")).alias("short"))
        ahead = ahead.select("source", F.coalesce("fits.key", "short.key").alias("first"), F.coalesce("fits.size", "short.size").alias("size"))
        anew = off.alias("t").join(ahead.alias("a"), F.expr("t.source <=> a.source")).select("t.source", "source_size", "target", "epochs", (F.col("room") - F.col("size")).alias("gap"), (F.col("room") - F.col("size")).alias("room"), F.expr(f"cast(array() as {RUNS})").alias("runs"), F.array_append("forced", F.col("first")).alias("forced"))
        anew = materialize(anew.select(*names), "anew")
        if anew.isEmpty():
            break
        tried = _close(groups, _fill(groups, anew))
        new = best.alias("t").join(tried.alias("n"), F.expr("t.source <=> n.source"), "left")
        nearer = F.expr("coalesce(n.miss < t.miss, false)")
        best = materialize(new.select("t.source", *[F.when(nearer, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in tried.columns if c != "source"], nearer.alias("open")), "best")
    chosen = best.select("source", "source_size", "target", "epochs", "runs", F.when(F.col("closing").isNotNull(), F.array_append("forced", F.col("closing"))).otherwise(F.col("forced")).alias("extra"))
    odd = groups.where("size > one").alias("g").join(chosen.alias("t"), F.expr("g.source <=> t.source"))
    odd = odd.where(_in_runs(F.col("key"), F.col("one"), F.col("runs")) & ~_in_runs(F.col("key"), F.col("size"), F.col("runs")))
    return chosen, materialize(odd.select("g.source", "key"), "odd")


def _in_runs(key: Column, size: Column, runs: Column) -> Column:
    return F.exists(runs, lambda x: (key > x["above"]) & (key <= x["upto"]) & (size <= x["most"]))


def copies(key: Column, size: Column, epochs: Column, runs: Column, extra: Column, odd: Column) -> Column:
    """How often the mix takes a row; ``odd`` marks the exceptions to the runs."""
    return (epochs + F.when((_in_runs(key, size, runs) & ~odd) | F.array_contains(extra, key), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (5, 2, 1), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(id, source, size, key)`` and the plan of a mix with its exceptions, see :func:`cutoffs`."""
    rows = materialize(sized(docs, id_col, text_col, source_col, quality_col), "sizes")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    w = weights if isinstance(weights, DataFrame) else cyclic_weights(sizes, tuple(weights))
    return rows, *cutoffs(rows, source_targets(sizes, w, most=most))


def mix_sources(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (5, 2, 1), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for each row, ``taken`` in words with repeats counted.

    A null source is a source of its own, a null text has size 0 and is taken 0 words. Rows with null or repeated ids are rows
    like others; rows equal in id and text are taken together. Other columns are ignored, an empty table gives no rows.
    Where a source's documents are of many sizes, its taken words miss the target by a few.
    """
    rows, plan, odd = mix_plan(docs, weights, most, id_col, text_col, source_col, quality_col)
    out = rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source")).join(odd.alias("o"), F.expr("r.source <=> o.source and r.key = o.key"), "left")
    n = copies(F.col("r.key"), F.col("size"), F.col("epochs"), F.col("runs"), F.col("extra"), F.col("o.key").isNotNull())
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * n).alias("taken"))


def mixed_documents(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (5, 2, 1), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; texts are not shuffled. Rows of size 0 go where no whole epoch takes them.

    All columns come back as they were, whatever their names.
    """
    _, plan, odd = mix_plan(docs, weights, most, id_col, text_col, source_col, quality_col)
    key, size, source, epochs, runs, extra, odd_source, odd_key, copy = free_names(docs.columns, "_key", "_size", "_source", "_epochs", "_runs", "_extra", "_odd_source", "_odd_key", "_copy")
    plan = plan.select(*[F.col(c).alias(n) for c, n in (("source", source), ("epochs", epochs), ("runs", runs), ("extra", extra))])
    odd = odd.select(F.col("source").alias(odd_source), F.col("key").alias(odd_key))
    measured = docs.withColumn(key, _measured(F.col(text_col).cast("string")))
    e, rate = _exponential(F.col(id_col), F.col(text_col).cast("string"), seed), F.col(quality_col).cast("double") if quality_col else F.col(f"{key}.prose")
    keyed = measured.withColumn(size, F.col(f"{key}.size")).withColumn(key, e / F.greatest(F.lit(0.05), rate))
    out = keyed.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col(source))).join(odd, F.col(source).eqNullSafe(F.col(odd_source)) & (F.col(key) == F.col(odd_key)), "left")
    n = copies(F.col(key), F.col(size), F.col(epochs), F.col(runs), F.col(extra), F.col(odd_key).isNotNull()).cast("int")
    return out.withColumn(copy, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))).select(*[F.col(quoted(c)) for c in docs.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _measured(text: Column) -> Column:
    """Size and share of prose, as :func:`sized` has them."""

    def run(texts):  # type: ignore[no-untyped-def]
        import pandas as pd

        parts = [size_and_prose(b.column("t")) for b in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), "t")]
        size, prose = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"size": size, "prose": prose})

    return F.pandas_udf(run, "size long, prose double")(text)
