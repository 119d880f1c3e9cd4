"""Toxicity by a classifier chain: one linear model per category, later ones fed with earlier categories' probabilities.

A later model learns from out-of-fold probabilities of the earlier ones, as it will meet them on new text.
Features are counts of words and word beginnings, chosen on the training sample. Where labels say only toxic or not, the earlier
categories are kinds of toxicity that the sample itself shows: clusters of toxic documents by the features they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.sampling import labelled_rows
from larkspan.llm.textkit import first_blocks, mix, slices, span_hashes, words

PREFIXES = (4, 5, 6, 7)


def word_features(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, hash, row)`` of words (length 0) and of their first 4 to 7 bytes, in lower case, a piece of text at a time."""
    for data, s, e, row in words(col):
        head, size = first_blocks(data, s, e), e - s
        yield 0, span_hashes(data, s, e) ^ np.uint64(1), row
        for k in PREFIXES:
            at = np.flatnonzero(size >= k)
            yield k, mix((head[at] & np.uint64((1 << 8 * k) - 1)) + np.uint64(k << 56)), row[at]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 8) -> np.ndarray:
    """Weights of a ridge logistic regression (Newton); the last column of ``x`` is the constant."""
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        v = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


@dataclass
class ChainModel:
    """``known``: the chosen features' hashes, sorted; ``weights``: a vector for each category in turn."""

    categories: list[str]
    known: np.ndarray
    weights: list[np.ndarray]

    def matrix(self, col: pa.Array) -> np.ndarray:
        n = len(col)
        table = np.zeros(1 << 16, bool)
        table[(self.known >> np.uint64(48)).astype(np.int64)] = True
        count, total = np.zeros((n, len(self.known))), np.zeros(n)
        for k, h, r in word_features(col):
            if not k:
                total += np.bincount(r, minlength=n)
            at = np.flatnonzero(table[(h >> np.uint64(48)).astype(np.int64)])
            h, r = h[at], r[at]
            if len(h) and len(self.known):
                i = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
                hit = self.known[i] == h
                np.add.at(count, (r[hit], i[hit]), 1)
        return np.column_stack([np.log1p(count), np.log1p(total) / 5, np.ones(n)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out: list[np.ndarray] = []
        for w in self.weights:
            out.append(sigmoid(np.column_stack([*out, x]) @ w))
        return np.column_stack(out)


def _pieces(texts: list[str]) -> list[pa.Array]:
    return [b.column("t") for b in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), "t")]


def choose_features(pieces: list[pa.Array], labels: np.ndarray, features: int) -> np.ndarray:
    """Sorted hashes of the features whose share of documents is most above the other side's, in standard errors, for any column of ``labels``."""
    y = labels.astype(np.float32)
    n = len(y)
    n1, n0 = np.maximum(1.0, y.sum(0)), np.maximum(1.0, n - y.sum(0))

    def tally(index: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
        total, pos, base = np.zeros(size, np.float32), np.zeros((y.shape[1], size), np.float32), 0
        for col in pieces:
            _, hashes, rows = zip(*word_features(col), (0, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            keep, i = index(np.concatenate(hashes))
            once = np.unique(i * np.int64(len(col)) + np.concatenate(rows)[keep])  # a document counts once
            i, r = once // len(col), once % len(col) + base
            total += np.bincount(i, minlength=size)
            for j in range(y.shape[1]):
                pos[j] += np.bincount(i, weights=y[r, j], minlength=size)
            base += len(col)
        share = (total + 1) / (n + 2)
        z = (pos / n1[:, None] - (total - pos) / n0[:, None]) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)[:, None])
        return np.where(total >= 3, z.max(0, initial=0), 0)

    # first by hash bucket, so that memory does not follow the vocabulary; then the features of the best buckets one by one
    bits = 21
    bucket = lambda h: (h >> np.uint64(64 - bits)).astype(np.int64)
    coarse = tally(lambda h: (np.arange(len(h)), bucket(h)), 1 << bits)
    good = np.zeros(1 << bits, bool)
    good[np.argsort(-coarse, kind="stable")[: 8 * features]] = True
    good &= coarse > 2
    found = [np.zeros(0, np.uint64)]
    for col in pieces:
        for _, h, _ in word_features(col):
            found.append(np.unique(h[good[bucket(h)]]))
    uniq = np.unique(np.concatenate(found))

    def exact(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.flatnonzero(good[bucket(h)])
        return keep, np.searchsorted(uniq, h[keep])

    best = tally(exact, len(uniq))
    pick = np.argsort(-best, kind="stable")[:features]
    return np.sort(uniq[pick[best[pick] > 3]])


def kinds_of(x: np.ndarray, kinds: int, rounds: int = 20) -> np.ndarray:
    """A cluster number for each row of counts: k-means of directions, from starts that are far apart."""
    u = x / np.maximum(1e-12, np.linalg.norm(x, axis=1))[:, None]
    out = np.zeros(len(u), int)
    if not len(u):
        return out
    centres = [u[np.argmax(u @ u.sum(0))]]
    while len(centres) < kinds:
        centres.append(u[np.argmin((u @ np.array(centres).T).max(1))])
    c = np.array(centres)
    for _ in range(rounds):
        new = (u @ c.T).argmax(1)
        if (new == out).all() and _:
            break
        out = new
        for k in range(kinds):
            if (out == k).any():
                c[k] = u[out == k].sum(0)
                c[k] /= max(1e-12, float(np.linalg.norm(c[k])))
    return out


def out_of_fold(x: np.ndarray, y: np.ndarray, folds: int, ridge: float) -> np.ndarray:
    """Each row's probability from a model that has not seen the row's fold (row number modulo ``folds``)."""
    fold, out = np.arange(len(x)) % folds, np.zeros(len(x))
    for f in range(folds):
        out[fold == f] = sigmoid(x[fold == f] @ fit_logistic(x[fold != f], y[fold != f], ridge))
    return out


def fit_chain(texts: list[str], labels: np.ndarray, categories: list[str], features: int = 400, folds: int = 4, ridge: float = 0.1) -> ChainModel:
    """Fit on texts and a 0/1 column per category, in the chain's order; see :func:`choose_features`."""
    pieces = _pieces(texts)
    model = ChainModel(categories, choose_features(pieces, labels, features), [])
    x = np.vstack([model.matrix(p) for p in pieces]) if pieces else np.zeros((0, len(model.known) + 2))
    earlier: list[np.ndarray] = []
    for j in range(labels.shape[1]):
        xj, yj = np.column_stack([*earlier, x]), labels[:, j].astype(float)
        model.weights.append(fit_logistic(xj, yj, ridge))
        earlier.append(out_of_fold(xj, yj, folds, ridge))
    return model


def split_kinds(texts: list[str], toxic: np.ndarray, kinds: int, features: int = 400) -> np.ndarray:
    """0/1 columns: kind 1 to ``kinds`` of the toxic texts, as they cluster, then toxic itself."""
    pieces = _pieces(texts)
    look = ChainModel([], choose_features(pieces, toxic[:, None], features), [])
    out = np.zeros((len(texts), kinds + 1), int)
    out[:, kinds] = toxic
    at = np.flatnonzero(toxic)
    if len(at):
        x = np.vstack([look.matrix(p)[:, :-2] for p in pieces])[at]
        out[at, kinds_of(x, kinds)] = 1
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = 6000, most_bytes: int = 1 << 26, kinds: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 1) -> ChainModel:
    """Fit the chain kind 1 -> ... -> toxic on at most ``most`` labelled documents of ``most_bytes`` bytes together (the documented bounds).

    ``toxic`` is the label; the kinds part the toxic documents of the sample. Null labels do not count. Without toxic documents, or without
    others, the chain gives every text the share that it saw.
    """
    sample = labelled_rows(docs.select(id_col, text_col), labels.where(F.col(label_col).isNotNull()).select(id_col, label_col), id_col, text_col, most, most_bytes, seed)
    rows = sample.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y")).toPandas().sort_values(["i", "t", "y"], kind="stable")
    texts, y = rows["t"].tolist(), rows["y"].to_numpy() > 0
    return fit_chain(texts, split_kinds(texts, y, kinds), [*[f"kind_{k + 1}" for k in range(kinds)], "toxic"])


def toxicity_column(model: ChainModel, text: Column) -> Column:
    """Array of the chain's probabilities, in the order of its categories. A null text counts as empty."""

    def score(texts):  # type: ignore[no-untyped-def]
        import pandas as pd

        out: list = []
        for b in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), "t"):
            out += list(model.probabilities(model.matrix(b.column("t"))))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(score, "array<double>")(text)


def score_toxicity(docs: DataFrame, model: ChainModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, p_<category> ..., score, toxic)`` for each row; ``score`` is the last category's probability, ``toxic`` whether it reaches
    ``threshold``. Null and repeated ids are rows like others, null texts count as empty; other columns are ignored."""
    names = [f"p_{c}" for c in model.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                p = model.probabilities(model.matrix(b.column("_text")))
                yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, -1]), pa.array(p[:, -1] >= threshold)], [id_col, *names, "score", "toxic"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema['_id'].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in [*names, "score"]) + ", toxic boolean")
