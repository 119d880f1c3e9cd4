"""Vectorised text kernels over Arrow buffers: words, shingles and hashes without a Python loop per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate tokens in the ``[^\x20\x09-\x0D]+`` sense.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "") if col.null_count else col
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def slices(batch: pa.RecordBatch, col: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``most`` text bytes, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def runs(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` bytes that do not cross rows: (starts, ends, row)."""
    m = inside[data]
    before = np.empty_like(m)
    before[1:], before[:1] = m[:-1], False
    firsts = off[:-1][off[:-1] < off[1:]]
    before[firsts] = False
    after = np.empty_like(m)
    after[:-1], after[-1:] = m[1:], False
    after[(off[1:] - 1)[off[:-1] < off[1:]]] = False
    s, e = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


#: Spans of up to this many bytes are hashed together, longer ones one by one.
SHORT = 32
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_KEYS = mix(np.arange(1, SHORT // 8 + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def first_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Up to eight bytes from ``starts`` on, as little-endian numbers; bytes from ``ends`` on count as zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.lib.stride_tricks.as_strided(padded.view(), (len(data) + 1, 8), (1, 1))[starts]
    block = np.ascontiguousarray(at).view("<u8").ravel()
    size = np.minimum(ends - starts, 8)
    mask = _ONES >> (np.minimum(8 - size, 7).astype(np.uint64) * np.uint64(8))
    return np.where(size > 0, block & mask, np.uint64(0))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: mixed blocks of eight bytes, chained and summed under keys; BLAKE2 for longer spans."""
    size = ends - starts
    chain = mix(size.astype(np.uint64) + _KEYS[0])
    total = np.zeros(len(starts), np.uint64)
    todo = np.arange(len(starts))
    for k in range(SHORT // 8):
        todo = todo[size[todo] > 8 * k] if k else todo
        if not len(todo):
            break
        block = first_blocks(data, starts[todo] + 8 * k, ends[todo])
        chain[todo] = mix(chain[todo] ^ block)
        total[todo] += mix(block + _KEYS[k + 1])
    out = mix(chain + total * _KEYS[0])
    for i in np.flatnonzero(size > SHORT):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def words(col: pa.Array, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(bytes, starts, ends, row)`` of the words of the lower-cased texts, in order, in pieces of about ``most`` bytes that are cut between words.

    Words are runs of letters, digits and non-ASCII characters.
    """
    data, off = buffers(pc.utf8_lower(pc.fill_null(col, "")))
    start = 0
    while start < len(data):
        end = min(start + most, len(data))
        if end < len(data):
            gap = np.flatnonzero(~WORD[data[start:end]])
            if len(gap):
                end = start + int(gap[-1]) + 1
            else:  # a word that is longer than a piece
                while end < len(data) and WORD[data[end]]:
                    end += 1
        piece = data[start:end]
        yield piece, *runs(piece, np.clip(off, start, end) - start, WORD)
        start = end


def word_hashes(col: pa.Array, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words in order, and row offsets."""
    hashes, count = [np.zeros(0, np.uint64)], np.zeros(len(col), np.int64)
    for data, s, e, row in words(col, most):
        hashes.append(span_hashes(data, s, e))
        count += np.bincount(row, minlength=len(count))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(count)])


def shingles(col: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Word ``n``-gram hashes (repeats included) and row offsets.

    A text of 1 to n-1 words has one shingle, all of it; a text without words has none.
    """
    coef = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    w, first = word_hashes(col)
    count = np.diff(first)
    have = np.where(count == 0, 0, np.maximum(1, count - n + 1))
    out_off = np.concatenate([[0], np.cumsum(have)])
    at = np.arange(out_off[-1]) - np.repeat(out_off[:-1], have) + np.repeat(first[:-1], have)
    acc = np.zeros(len(at), np.uint64)
    left = np.repeat(first[1:], have) - at
    for j in range(n):
        ok = left > j
        acc[ok] += w[at[ok] + j] * coef[j]
    return mix(acc), out_off


def size_and_prose(col: pa.Array, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of maximal runs of non-blank bytes, and the share of bytes in words or blanks. Long rows are gone through in pieces."""
    data, off = buffers(col)
    size, prose = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    firsts = off[:-1][off[:-1] < off[1:]]
    for start in range(0, len(data), most):
        end = min(start + most, len(data))
        solid = ~SPACE[data[start:end]]
        before = np.zeros(len(solid), bool)
        before[1:], before[0] = solid[:-1], start > 0 and not SPACE[data[start - 1]]
        a, b = np.searchsorted(firsts, [start, end])
        before[firsts[a:b] - start] = False
        first, last = np.searchsorted(off, [start, end - 1], "right") - 1
        rows = np.searchsorted(off, np.flatnonzero(solid & ~before) + start, "right") - 1
        size[first : last + 1] += np.bincount(rows - first, minlength=last + 1 - first)
        run = np.concatenate([[0], np.cumsum((WORD | SPACE)[data[start:end]])])
        edge = np.clip(off[first : last + 2], start, end) - start
        prose[first : last + 1] += run[edge[1:]] - run[edge[:-1]]
    return size, prose / np.maximum(1, off[1:] - off[:-1])
