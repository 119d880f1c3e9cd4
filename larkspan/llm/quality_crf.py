"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's score comes from its own features and those of the lines before and after it;
neighbouring labels are tied by the chain. Forward-backward marginals, weighted by line length, make the document's score.
Labels are of documents, so line labels are hidden in training: the field is fitted through the document scores that its marginals make.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.line_dedup import line_spans
from larkspan.llm.sampling import labelled_rows
from larkspan.llm.textkit import SPACE, buffers, slices, span_hashes

#: Byte classes: letters of either case, digits, sentence marks, table bars, exclamation marks, other ASCII marks, blanks, the rest.
_CLASS = np.full(256, 7, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:'\"?()-", b"|", b"!")):
    _CLASS[list(_bytes)] = _k
_CLASS[[i for i in range(33, 127) if _CLASS[i] == 7]] = 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 8


def line_features(col: pa.Array, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, row, bytes) of each line of each text; a row has one line at least.

    Features are of the line and of its neighbours; nothing tells of the document. Texts are gone through in pieces of about ``most`` bytes, cut at blanks.
    """
    data, off = buffers(col)
    s, e, row, pos = line_spans(data, off)
    n, size = len(s), (e - s).astype(np.float64)
    share = np.zeros((n, 7))
    hashes, lines, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    start = 0
    while start < len(data):
        end = _after_blank(data, min(start + most, len(data)), start)
        piece = data[start:end]
        first, last = np.searchsorted(s, [start, end - 1], "right") - 1
        edge = np.clip(s[first : last + 1], start, end) - start
        line_of = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, end - start)))
        share[first : last + 1] += np.bincount(line_of * 9 + _CLASS[piece], minlength=len(edge) * 9).reshape(-1, 9)[:, :7]
        ws, we = _runs_in_lines(piece, ~SPACE[piece], edge)
        hashes.append(span_hashes(piece, ws, we))
        lines.append(line_of[ws] + first)
        lengths.append(we - ws)
        start = end
    share /= np.maximum(size, 1)[:, None]
    h, wl = np.concatenate(hashes), np.concatenate(lines)
    words = np.bincount(wl, minlength=n).astype(float)
    twice = np.zeros(len(h), bool)
    twice[1:] = (h[1:] == h[:-1]) & (wl[1:] == wl[:-1])
    again = np.bincount(wl, weights=twice, minlength=n) / np.maximum(words, 1)
    order = np.lexsort((h, wl))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (wl[order][1:] != wl[order][:-1])
    distinct = np.bincount(wl[order], weights=new, minlength=n) / np.maximum(words, 1)
    mean_word = np.bincount(wl, weights=np.concatenate(lengths), minlength=n) / np.maximum(words, 1)
    core = np.column_stack([share, again, distinct, np.minimum(mean_word, 40) / 10, np.log1p(size) / 5, np.log1p(words) / 4, size == 0, *[size < k for k in (50, 100, 200)]])
    before, after = np.zeros_like(core), np.zeros_like(core)
    same = row[1:] == row[:-1]
    before[1:][same], after[:-1][same] = core[:-1][same], core[1:][same]
    edge = np.column_stack([pos == 0, np.append(~same, True)])
    return np.column_stack([core, before, after, edge, np.ones(n)]), row, size


def _after_blank(data: np.ndarray, end: int, start: int) -> int:
    """The place after the last blank before ``end``; where a word is longer than that, its own end."""
    if end == len(data):
        return end
    blank = np.flatnonzero(SPACE[data[start:end]])
    if len(blank):
        return start + int(blank[-1]) + 1
    while end < len(data) and not SPACE[data[end]]:
        end += 1
    return end


def _runs_in_lines(data: np.ndarray, solid: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of non-blank bytes; they do not cross lines (the break is blank) nor rows (a row starts a line)."""
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    at = starts[starts < len(data)]
    before[at] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[at[at > 0] - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


@dataclass
class QualityCrf:
    """``mean`` and ``scale`` standardise features, ``emit`` scores good against bad, ``pair[a, b]`` scores label b after a."""

    mean: np.ndarray
    scale: np.ndarray
    emit: np.ndarray
    pair: np.ndarray

    def line_scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.emit

    def lines(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chance that the line is good, row, bytes) of each line."""
        x, row, size = line_features(col)
        return marginals(self.line_scores(x), row, self.pair)[0], row, size

    def score(self, col: pa.Array) -> np.ndarray:
        good, row, size = self.lines(col)
        return np.clip(np.bincount(row, weights=good * shares(row, size), minlength=len(col)), 0, 1)


def shares(row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each line's share of its document's length. Empty lines weigh next to nothing, but a document of them has a score."""
    w = np.maximum(size, 1e-3)
    return w / np.bincount(row, weights=w)[row]


def _pad(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, step, length) of consecutive lines, sequences ordered from the longest."""
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(row)))
    rank = np.empty(len(start), np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(len(start))
    return np.repeat(rank, length), np.arange(len(row)) - np.repeat(start, length), np.sort(length)[::-1]


def marginals(score: np.ndarray, row: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance that each line is good, expected label pairs and log partition function of each sequence); label 1 is good.

    Sequences advance together, longest first, so that each step works on those that are still running.
    """
    seq, step, length = _pad(row)
    steps = int(length[0]) if len(length) else 0
    at = np.lexsort((seq, step))
    e = score[at]
    alive = [int((length > t).sum()) for t in range(steps)]
    first = np.concatenate([[0], np.cumsum(alive)]).astype(np.int64)
    a = np.zeros((len(score), 2))
    for t in range(steps):
        s, k = first[t], alive[t]
        em = np.column_stack([np.zeros(k), e[s : s + k]])
        if t:
            prev = a[first[t - 1] : first[t - 1] + k]
            em = em + np.logaddexp(prev[:, :1] + pair[0], prev[:, 1:] + pair[1])
        a[s : s + k] = em
    b, pairs = np.zeros((len(score), 2)), np.zeros((len(length), 2, 2))
    log_z = np.zeros(len(length))
    for t in range(steps - 1, -1, -1):
        s, k = first[t], alive[t]
        nxt = alive[t + 1] if t + 1 < steps else 0
        log_z[nxt:k] = np.logaddexp(a[s + nxt : s + k, 0], a[s + nxt : s + k, 1])
        if nxt:
            s2 = first[t + 1]
            out = b[s2 : s2 + nxt] + np.column_stack([np.zeros(nxt), e[s2 : s2 + nxt]])
            b[s : s + nxt] = np.column_stack([np.logaddexp(pair[i, 0] + out[:, 0], pair[i, 1] + out[:, 1]) for i in (0, 1)])
            for i in (0, 1):
                for j in (0, 1):
                    pairs[:nxt, i, j] += np.exp(np.minimum(0, a[s : s + nxt, i] + pair[i, j] + out[:, j] - log_z[:nxt]))
    z = np.concatenate([log_z[:k] for k in alive]) if steps else np.zeros(0)
    good = np.empty(len(score))
    good[at] = np.exp(np.minimum(0, a[:, 1] + b[:, 1] - z))
    place = seq[np.flatnonzero(step == 0)]  # back from longest first to the order of rows
    return good, pairs[place], log_z[place]


def score_gradient(theta: np.ndarray, pair: np.ndarray, docs: np.ndarray, share: np.ndarray, eps: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each document, its derivative by each line's score, its derivative by the pair scores).

    A score is the shares' sum over marginals, and marginals are derivatives of log partition functions. Its derivatives are thus those of the
    marginals in the direction of the shares, taken as a difference: two more copies of each document in the forward-backward pass.
    """
    n, lines = int(docs[-1]) + 1, len(theta)
    good, pairs, _ = marginals(np.concatenate([theta, theta + eps * share, theta - eps * share]), np.concatenate([docs, docs + n, docs + 2 * n]), pair)
    by_line, by_pair = (good[lines : 2 * lines] - good[2 * lines :]) / (2 * eps), (pairs[n : 2 * n] - pairs[2 * n :]) / (2 * eps)
    return np.bincount(docs, weights=good[:lines] * share), by_line, by_pair


def fit_crf(x: np.ndarray, row: np.ndarray, size: np.ndarray, good: np.ndarray, rounds: int = 120, ridge: float = 2.0) -> QualityCrf:
    """Maximum likelihood of the documents' labels ``good`` given their scores, with a ridge, by Adam. Line labels stay hidden."""
    mean, scale = x.mean(0), x.std(0)
    const = scale < 1e-9
    mean[const], scale[const] = 0.0, 1.0
    z = (x - mean) / scale
    docs = np.unique(row, return_inverse=True)[1]
    share = shares(docs, size)
    y, n = np.asarray(good, float), len(good)
    w, pair = np.zeros(x.shape[1]), np.array([[0.5, -0.5], [-0.5, 0.5]])
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    pen = np.concatenate([np.full(len(w), ridge), np.full(4, 20.0)]) / n
    for k in range(1, rounds + 1):
        score, by_line, by_pair = score_gradient(z @ w, pair, docs, share)
        p = np.clip(score, 0.01, 0.99)
        pull = y / p - (1 - y) / (1 - p)
        g = np.concatenate([z.T @ (by_line * pull[docs]), (by_pair * pull[:, None, None]).sum(0).ravel()]) / n - pen * np.concatenate([w, pair.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.08 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, pair = w + step[:-4], pair + step[-4:].reshape(2, 2)
    return QualityCrf(mean, scale, w, pair)


def fit_texts(texts: list[str], good: np.ndarray, **fit) -> QualityCrf:
    """Fit on whole texts and a label for each."""
    if not len(texts):
        width = line_features(pa.array([""]))[0].shape[1]
        return QualityCrf(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)))
    parts, base = [], 0
    for b in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), "t"):
        x, r, size = line_features(b.column("t"))
        parts.append((x, r + base, size))
        base += b.num_rows
    x, row, size = (np.concatenate(c) for c in zip(*parts))
    return fit_crf(x, row, size, good, **fit)


def train_quality(docs: DataFrame, labels: DataFrame, most: int = 3000, most_bytes: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 1) -> QualityCrf:
    """Fit on at most ``most`` labelled documents of ``most_bytes`` bytes together (the documented bounds); null labels do not count."""
    sample = labelled_rows(docs.select(id_col, text_col), labels.where(F.col(label_col).isNotNull()).select(id_col, label_col), id_col, text_col, most, most_bytes, seed)
    rows = sample.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y")).toPandas().sort_values(["i", "t", "y"], kind="stable")
    return fit_texts(rows["t"].tolist(), rows["y"].to_numpy() > 0)


def score_quality(docs: DataFrame, model: QualityCrf, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)`` for each row: the chance of good quality, and 1 where it reaches ``threshold``.

    A null or empty text is one empty line. Null and repeated ids are rows like others; only the text is an input of the score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                p = model.score(b.column("_text"))
                yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema['_id'].dataType.simpleString()}, score double, predicted int")
