"""Line dedup over the corpus, as a keep bitmap per document.

A normalised line is known by its BLAKE2 digest of 128 bits, so that no two different lines meet by any structure of theirs.
Digests are range-partitioned together with the document id, so that a very common line
spreads over partitions, and sorted by hash, then document (largest first), then position. Streaming over a partition keeps a line's first
document and drops the rest; lines that touch a partition's edge are settled by
joining the edges' totals, at most two rows per partition.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.names import free_names
from larkspan.llm.scratch import materialize, release, shuffle_partitions
from larkspan.llm.textkit import slices

#: ASCII blanks, which a line's key loses at both ends.
BLANKS = b" \t\n\x0b\x0c\r"
NAMES = ["kind", "h1", "h2", "id", "th", "pos", "n", "docs"]
TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r"""Lines of each row split at ``\n``: (starts, ends, row, position). An empty row has one empty line."""
    nl = np.flatnonzero(data == 10)
    row_nl = np.searchsorted(off, nl, "right") - 1
    starts = np.concatenate([off[:-1], nl + 1])
    row = np.concatenate([np.arange(len(off) - 1), row_nl])
    order = np.argsort(row, kind="stable")
    starts, row = starts[order], row[order]
    first = np.searchsorted(row, np.arange(len(off)))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = off[1:]
    return starts, ends, row, np.arange(len(row)) - first[row]


def line_digests(text: bytes, min_points: int) -> Iterator[tuple[int, bytes]]:
    """``(position, digest)`` of each line whose key has ``min_points`` code points or more; no more than a line is held at once."""
    for pos, line in enumerate(io.BytesIO(text)):
        key = line.strip(BLANKS)
        if len(key) >= min_points and (key.isascii() or len(key.decode()) >= min_points):
            yield pos, hashlib.blake2b(key.lower(), digest_size=16).digest()


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = 20, min_docs: int = 3) -> DataFrame:
    r"""``(id, text_hash, n_lines, n_dropped, bitmap)`` for the documents that lose lines, and only those.

    A line's key is the line stripped of ASCII blanks at both ends, A-Z lower-cased. Keys of at least ``min_points``
    code points found in at least ``min_docs`` documents lose all their lines except those in the largest id
    that holds them. ``bitmap`` is zlib-compressed, one bit per line, least significant first, 1 to keep.
    Rows that share an id count as one document; ``text_hash`` (xxhash64) tells their texts apart. Rows with a null id
    neither count nor lose lines. A null or empty text is one empty line.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").withColumn("th", F.xxhash64("text"))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "id", "th", "pos", "n"]

        def out(rows: list[tuple[bytes, int, int, int, int]]) -> pa.RecordBatch:
            digest, *rest = zip(*rows) if rows else [()] * 5
            h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.int32(), pa.int32())))], names)

        for whole in batches:
            for b in slices(whole, "text"):
                rows: list[tuple[bytes, int, int, int, int]] = []
                for id_, th, text in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), pc.fill_null(b.column("text"), "").cast(pa.binary()).to_pylist()):
                    n = text.count(b"\n") + 1
                    for pos, digest in line_digests(text, min_points):
                        rows.append((digest, id_, th, pos, n))
                        if len(rows) >= 1 << 16:
                            yield out(rows)
                            rows = []
                yield out(rows)

    # written first: dealing to ranges samples its input, and would read and digest all texts twice
    rows = materialize(src.mapInArrow(exploded, "h1 long, h2 long, id long, th long, pos int, n int"), "line-keys")
    keys = rows
    rows = rows.repartitionByRange(shuffle_partitions(spark), "h1", "h2", F.desc("id")).sortWithinPartitions("h1", "h2", F.desc("id"), "pos")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a line to drop. 1: of a line at an edge of the partition, not settled. 2: an edge line's documents and largest id.

        Ids fall within a line, so the first document is the one that keeps it, and from the
        ``min_docs``-th document on all others can go at once: no more than the rows of ``min_docs - 1`` documents are held.
        """

        def out(kind: int, rows: list[np.ndarray], at: np.ndarray) -> pa.RecordBatch:
            k = len(at)
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), *(pa.array(x[at]) for x in rows), pa.array(np.zeros(k, np.int64))], NAMES)

        def edge(key: tuple, docs: int, top: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": [2], "h1": [key[0]], "h2": [key[1]], "id": [top], "th": [0], "pos": [0], "n": [0], "docs": [docs]}, pa.schema(list(zip(NAMES, TYPES))))

        held: list[np.ndarray] | None = None  # rows of the open line while it has too few documents
        key, docs, top, seen = None, 0, 0, 0  # the open line, and what of it was already sent
        opening = True  # the open line is the partition's first
        for b in batches:
            if not b.num_rows:
                continue
            c = [b.column(k).to_numpy() for k in NAMES[1:7]]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c)]
            new = np.ones(len(c[0]), bool)
            new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(new))
            fresh = new.copy()
            fresh[1:] |= c[2][1:] != c[2][:-1]
            n_docs, tops = np.add.reduceat(fresh.astype(np.int64), starts), c[2][starts].copy()
            if held is None and key == (c[0][0], c[1][0]):
                n_docs[0] += docs - (c[2][0] == seen)
                tops[0] = top
            elif opening and key is not None:
                opening = False
                yield edge(key, docs, top)
            skip = 0
            if opening:
                yield out(1, c, np.arange(ends[0]))
                skip = 1
                if len(starts) > 1:
                    opening = False
                    yield edge((int(c[0][0]), int(c[1][0])), int(n_docs[0]), int(tops[0]))
            go = np.flatnonzero(n_docs >= min_docs)
            go = go[go >= skip]
            size = ends[go] - starts[go]
            at = np.repeat(starts[go] - np.cumsum(size) + size, size) + np.arange(size.sum())
            at = at[c[2][at] != np.repeat(tops[go], size)]
            if len(at):
                yield out(0, c, at)
            key, docs, top, seen = (int(c[0][-1]), int(c[1][-1])), int(n_docs[-1]), int(tops[-1]), int(c[2][-1])
            held = None if opening or docs >= min_docs else [x[starts[-1] :] for x in c]
        if key is not None:
            if held is not None:
                yield out(1, held, np.arange(len(held[0])))
            yield edge(key, docs, top)

    found = materialize(rows.mapInArrow(streamed, "kind int, h1 long, h2 long, id long, th long, pos int, n int, docs long"), "lines")
    release(keys)
    edges = found.where("kind = 2").groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("id").alias("top")).where(F.col("all_docs") >= min_docs)
    late = found.where("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).where("id != top")  # two rows per partition at most
    lost = found.where("kind = 0").select("id", "th", "pos", "n").union(late.select("id", "th", "pos", "n"))
    packed = lost.groupBy("id", "th", "n").agg(F.collect_set("pos").alias("gone"))

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for n, gone in zip(b.column("n").to_pylist(), b.column("gone")):
                keep = np.ones(n, bool)
                keep[gone.values.to_numpy()] = False
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pc.cast(b.column("n"), pa.int64()), pc.cast(pc.list_value_length(b.column("gone")), pa.int64()), pa.array(maps, pa.binary())], [id_col, "text_hash", "n_lines", "n_dropped", "bitmap"])

    return packed.mapInArrow(bitmap, f"`{id_col}` long, text_hash long, n_lines long, n_dropped long, bitmap binary")


def apply_bitmap(text: str | None, bitmap: bytes | None) -> str | None:
    r"""The lines that a bitmap keeps, joined by ``\n``; the text itself without a bitmap."""
    if bitmap is None or text is None:
        return text
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").tobytes()
    return "\n".join(itertools.compress(text.split("\n"), keep))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``docs`` with two more columns at its end, ``_bitmap`` and ``_n_dropped`` (null where nothing goes).

    Where ``docs`` has columns of these names, the new ones bear another underscore: all columns of ``docs`` stay as they are.
    """
    kept, dropped, id_, th, own = free_names(docs.columns, "_bitmap", "_n_dropped", "_id", "_th", "_h")
    maps = line_keep_bitmaps(docs.select(id_col, text_col), id_col, text_col, **rule)
    maps = maps.select(F.col(id_col).alias(id_), F.col("text_hash").alias(th), F.col("bitmap").alias(kept), F.col("n_dropped").alias(dropped))
    left = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    both = left.join(maps, (F.col(id_col).cast("long") == F.col(id_)) & (F.col(own) == F.col(th)), "left")
    return both.select(*docs.columns, kept, dropped)


def digests(deduped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``(id, n_lines, n_dropped, kept_sha256)`` of what :func:`dedup_lines` returned."""
    bitmap, dropped = deduped.columns[-2:]
    kept = F.coalesce(kept_text(F.coalesce(text_col, F.lit("")), F.col(bitmap)), F.lit(""))
    n = F.length(F.coalesce(text_col, F.lit(""))) - F.length(F.replace(F.coalesce(text_col, F.lit("")), F.lit("\n"))) + 1
    return deduped.select(id_col, n.cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def _kept(text, bitmap):  # type: ignore[no-untyped-def]
    import pandas as pd

    return pd.Series([apply_bitmap(t, m) for t, m in zip(text, bitmap)], dtype=object)


def kept_text(text, bitmap):
    """The text that a bitmap leaves; texts without one do not go through Python."""
    return F.when(bitmap.isNull(), text).otherwise(F.pandas_udf(_kept, "string")(F.when(bitmap.isNotNull(), text), bitmap))
