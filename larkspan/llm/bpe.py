"""Byte-level BPE by a global shuffle of distinct words.

Documents are cut into pre-tokens. A chunk of documents keeps each pre-token's position as a number into
the chunk's own word list, and sends each distinct word, once, to the task that owns it. That task merges each
distinct word of the corpus once and returns its ids to the chunks, which put them together by position.
Word lists and ids travel as packed, compressed blocks, not as a row for each occurrence.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import materialize, shuffle_partitions
from larkspan.llm.textkit import slices

#: Text bytes of a chunk; a longer document is a chunk of its own. A chunk has some ten thousand distinct words or more.
CHUNK_BYTES = 4 << 20
#: Tasks that own words, at most: with more of them a chunk's word blocks would hold a few words each.
OWNERS = 1024
#: Tokens of a document that are put together at once.
STEP = 1 << 16


def _pack(a: np.ndarray | bytes) -> bytes:
    raw = a if isinstance(a, bytes) else np.ascontiguousarray(np.ascontiguousarray(a, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(b: bytes) -> bytes:
    return pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(b), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of ``base64 id`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


_encoders: dict = {}


def _encoder(raw: bytes):
    """Merges one word; what a worker builds is kept for its later tasks."""
    key = hashlib.sha256(raw).digest()
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        # the pattern takes a word whole: words are cut before
        _encoders[key] = tiktoken.Encoding("word", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary, {v: k for k, v in ranks.items()}
    return _encoders[key]


def _settled(docs: DataFrame) -> DataFrame:
    """``docs``, written first if its plan has a shuffle: rows that a lost task brings again must come in the same order, as chunks follow it."""
    return materialize(docs, "texts") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def _reassembled(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, fields: list[tuple[str, pa.DataType, str]], make: Callable) -> DataFrame:
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())  # a vocabulary file; its size does not follow the input
    parts = shuffle_partitions(spark)
    owners = min(4 * parts, OWNERS)
    src = _settled(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        find, find_all = compiled.finditer, compiled.findall  # the first holds no list of a long text's words
        number, base = itertools.count(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in slices(whole, "text", CHUNK_BYTES):
                chunk = base + next(number)
                seen: dict[str, int] = defaultdict(itertools.count().__next__)
                at, sizes = [], []
                for t in b.column("text").to_pylist():
                    at.append(np.fromiter((seen[m[0]] for m in find(t)) if len(t) > CHUNK_BYTES // 4 else map(seen.__getitem__, find_all(t)), np.uint32))
                    sizes.append(len(at[-1]))
                words = [w.encode() for w in seen]
                stamp = int.from_bytes(hashlib.blake2b(b"\0".join(words), digest_size=8).digest(), "little", signed=True)
                owner = np.fromiter((zlib.crc32(w) % owners for w in words), np.int64, len(words))
                order = np.argsort(owner, kind="stable")
                p, first = np.unique(owner[order], return_index=True)
                blocks = []
                for s, e in zip(first, [*first[1:], len(order)]):
                    own = [words[i] for i in order[s:e]]
                    blocks.append((_pack(order[s:e]), _pack(np.array(list(map(len, own)))), _pack(b"".join(own))))
                n = len(p)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([-1 - chunk, *p.tolist()], pa.int64()), pa.array([chunk] * (n + 1), pa.int64()), pa.array([stamp] * (n + 1), pa.int64()), pa.array([b.column("id").to_pylist()] + [None] * n, pa.list_(pa.int64())), pa.array([sizes] + [None] * n, pa.list_(pa.int32())),
                        pa.array([_pack(np.concatenate(at)), *(x[0] for x in blocks)], pa.binary()), pa.array([None, *(x[1] for x in blocks)], pa.binary()), pa.array([None, *(x[2] for x in blocks)], pa.binary()),
                    ],
                    ["key", "chunk", "stamp", "ids", "sizes", "at", "lens", "words"],
                )

    # one shuffle for both: word blocks go to their owners, positions wait for the ids at their chunk's key
    pieces = src.mapInArrow(cut, "key long, chunk long, stamp long, ids array<long>, sizes array<int>, at binary, lens binary, words binary").repartition(parts, "key")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = _encoder(shipped.value)
        known: dict[bytes, np.ndarray] = {}
        last = None
        for b in batches:
            for i in np.flatnonzero(b.column("key").to_numpy() >= 0).tolist():
                owner = b.column("key")[i].as_py()
                if owner != last:
                    known, last = {}, owner
                raw, out = _unpack(b.column("words")[i].as_py()), []
                end = np.cumsum(_numbers(b.column("lens")[i].as_py())).tolist()
                for s, e in zip([0, *end], end):
                    w = raw[s:e]
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w.decode())
                    out.append(got)
                lens = np.array(list(map(len, out)))
                flat = np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(lens.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([-1 - b.column("chunk")[i].as_py()], pa.int64()), b.column("stamp").slice(i, 1), b.column("at").slice(i, 1), pa.array([_pack(lens)], pa.binary()), pa.array([_pack(flat)], pa.binary())], ["key", "stamp", "at", "lens", "tokens"])

    coded = pieces.sortWithinPartitions("key").mapInArrow(merged, "key long, stamp long, at binary, lens binary, tokens binary")
    schema = pa.schema([pa.field(id_col, pa.int64()), *(pa.field(n, t) for n, t, _ in fields)])

    def joined(_key, head: pa.Table, parts: pa.Table) -> pa.Table:
        rows = [r for r in head.to_pylist() if r["key"] < 0]
        if not rows:
            return schema.empty_table()
        ids, sizes, at = rows[0]["ids"], rows[0]["sizes"], _numbers(rows[0]["at"])
        if any(r["stamp"] != rows[0]["stamp"] for r in parts.to_pylist()):
            raise RuntimeError("a chunk's words are not those of its positions: its input changed between two runs of a task")
        blocks = [tuple(_numbers(r[c]) for c in ("at", "lens", "tokens")) for r in parts.to_pylist()]
        word_ids: list = [None] * sum(len(b[0]) for b in blocks)
        for where, lens, tokens in blocks:
            end = np.cumsum(lens).tolist()
            for k, s, e in zip(where.tolist(), [0, *end], end):
                word_ids[k] = tokens[s:e]
        emit = make(word_ids, _encoder(shipped.value)[1])
        out, start = [], 0
        for size in sizes:
            out.append(emit(at[start : start + size]))
            start += size
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[j] for r in out], t) for j, (_, t, _) in enumerate(fields))], schema=schema)

    return pieces.groupBy("key").cogroup(coded.groupBy("key")).applyInArrow(joined, ", ".join([f"`{id_col}` long", *(f"`{n}` {t}" for n, _, t in fields)]))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, token_ids)`` of each row's whole text, as ``encode_ordinary`` of that vocabulary gives.

    A null text is empty and has no tokens. Rows are kept one for one, with null and repeated ids too; other columns are ignored.
    """

    def make(word_ids, _table):
        return lambda at: (np.concatenate([word_ids[k] for k in at] or [np.zeros(0, np.uint32)]).astype(np.int32),)

    return _reassembled(docs, id_col, text_col, ranks_path, pattern, [("token_ids", pa.list_(pa.int32()), "array<int>")], make)


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids and of the bytes that they decode to.

    Rows as :func:`encode_documents` has them. The decoded bytes come from the ids by the token-byte table.
    """

    def make(word_ids, table):
        listed = [x.tolist() for x in word_ids]
        text = [" ".join(map(str, x)) for x in listed]
        back = [b"".join([table[i] for i in x]) for x in listed]
        count = np.array([len(x) for x in listed], np.int64)

        def emit(at: np.ndarray) -> tuple[int, str, str]:
            ids, plain = hashlib.sha256(), hashlib.sha256()
            for start in range(0, len(at), STEP):
                k = at[start : start + STEP].tolist()
                ids.update(((" " if start else "") + " ".join([text[i] for i in k])).encode())
                plain.update(b"".join([back[i] for i in k]))
            return int(count[at].sum()), ids.hexdigest(), plain.hexdigest()

        return emit

    return _reassembled(docs, id_col, text_col, ranks_path, pattern, [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")], make)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``(id, text_bytes)``: the bytes that the ids stand for. An id outside the vocabulary is an error; null ids give null."""
    with open(ranks_path, "rb") as f:
        shipped = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _encoder(shipped.value)[1]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else b"".join([table[i] for i in x]) for x in b.column(1).to_pylist()], pa.binary())], [id_col, "text_bytes"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` long, text_bytes binary")
