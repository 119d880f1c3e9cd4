"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import materialize

#: Words by which an analyst would label a host at sight, by category. They stand for a block list where none is given.
BAD_WORDS = {
    "gambling": ("bet", "bets", "bingo", "casino", "jackpot", "lottery", "poker", "roulette", "slots"),
    "adult": ("adult", "escort", "porn", "sex", "xxx"),
    "advertising": ("ads", "adserver", "banner", "clicks", "popup", "track", "tracker"),
    "spam": ("phishing", "scam", "spam", "warez"),
    "pharmacy": ("cialis", "pills", "pharma", "viagra"),
    "money": ("loans", "payday", "replica"),
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (``host/path``) that fits, or null. A rule fits its host and all subdomains, when the path begins with its path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical_features(host: str, path: str, url: str) -> list[float]:
    query = url.partition("#")[0].partition("?")[2]
    n = len(url)
    digits = sum(c.isdigit() for c in url)
    count = np.bincount(np.frombuffer(host.encode(), np.uint8)) if host else np.zeros(1)
    p = count[count > 0] / max(1, count.sum())
    labels = host.split(".")
    return [
        n, len(host), len(path), path.count("/"), host.count("."), digits / max(1, n), sum(c.isdigit() for c in host), host.count("-"), float(-(p * np.log2(p)).sum()),
        query.count("=") if query else 0, len(query), url.count("%"), "#" in url, url.startswith("https:"), max(map(len, labels)), len(re.findall(r"[^A-Za-z0-9/._~:?#=&%-]", url)),
    ]


@dataclass
class Trees:
    """Boosted trees on binned features: each level's (feature, cut bin) of a tree is shared by its nodes' paths."""

    cuts: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), int)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.bins(x), np.full(len(x), self.base), np.arange(len(x))
        for feat, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (b[rows, feat[node]] > cut[node])
            out += leaf[node - len(feat)]
        return 1 / (1 + np.exp(-out))


def matrix(hosts: list[str], paths: list[str], urls: list[str], shares: np.ndarray) -> np.ndarray:
    """Lexical features, then the suffix statistics as rounded log odds: trees must not tell folds apart by the last digits."""
    own = np.array([lexical_features(*x) for x in zip(hosts, paths, urls)], float).reshape(len(hosts), -1)
    p = np.clip(shares.reshape(len(hosts), -1), 1e-6, 1 - 1e-6)
    return np.column_stack([own, np.rint(2 * np.log(p / (1 - p))) / 2])


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the log loss with complete trees of ``depth`` levels."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    rate_y = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(cuts, float(np.log(rate_y / (1 - rate_y))))
    b, raw = model.bins(x), np.full(len(y), model.base)
    width = bins + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        inner = 2**depth - 1
        feat, cut, node = np.zeros(inner, np.int64), np.full(inner, width), np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, k = 2**level - 1, 2**level
            best = np.full(k, 1e-9)
            for j in range(x.shape[1]):
                at = (node - lo) * width + b[:, j]
                sg = np.bincount(at, weights=g, minlength=k * width).reshape(k, width).cumsum(1)
                sh = np.bincount(at, weights=h, minlength=k * width).reshape(k, width).cumsum(1)
                gain = sg**2 / (sh + ridge) + (sg[:, -1:] - sg) ** 2 / (sh[:, -1:] - sh + ridge) - sg[:, -1:] ** 2 / (sh[:, -1:] + ridge)
                top = gain.argmax(1)
                better = gain[np.arange(k), top] > best
                best = np.where(better, gain[np.arange(k), top], best)
                feat[lo : lo + k] = np.where(better, j, feat[lo : lo + k])
                cut[lo : lo + k] = np.where(better, top, cut[lo : lo + k])
            node = 2 * node + 1 + (b[np.arange(len(y)), feat[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + ridge)
        raw += leaf[at]
        model.trees.append((feat, cut, leaf))
    return model


def suffixes_of(host: Column) -> Column:
    """The host's last one, two and three labels; shorter hosts repeat."""
    parts = F.split(host, "[.]")
    return F.array(*[F.concat_ws(".", F.slice(parts, -F.least(F.size(parts), F.lit(k)), F.least(F.size(parts), F.lit(k)))) for k in (1, 2, 3)])


def suffix_counts(hosts: DataFrame, sums: list[str]) -> DataFrame:
    """``(suffix, <sums>)`` below each suffix of all ``hosts(host, <sums>)``."""
    s = hosts.select(F.explode(F.array_distinct(suffixes_of(F.col("host")))).alias("suffix"), *sums)
    return s.groupBy("suffix").agg(*[F.sum(c).alias(c) for c in sums])


def suffix_shares(rows: DataFrame, counts: DataFrame, prior: float, key: str = "host", out: str = "") -> DataFrame:
    """``(key, shares)``: the share of bad URLs below the last one, two and three labels of each row's host, smoothed toward ``prior`` by five URLs.

    ``out`` names a column of ``rows`` with the name of a fold: the counts leave out this fold's URLs.
    """
    names = [c for c in counts.columns if c.startswith("n_")]
    less = lambda c: sum((F.when(F.col(out) == x[2:], F.col(f"{c}_{x[2:]}")).otherwise(0) for x in names), F.lit(0)) if out else F.lit(0)
    each = rows.select(key, *([out] if out else []), F.posexplode(suffixes_of(F.col("host"))).alias("at", "suffix")).join(counts, "suffix", "left")
    n, bad = (F.coalesce(F.col(c) - less(c), F.lit(0)) for c in ("n", "bad"))
    share = each.select(key, "at", ((bad + 5 * F.lit(prior)) / (n + 5)).alias("share"))
    return share.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "share"))).alias("s")).select(key, F.col("s.share").alias("shares"))


@dataclass
class UrlModel:
    """Trees, and what they need to know of suffixes: ``(suffix, n, bad)``, a table as large as the labelled hosts are many."""

    trees: Trees
    counts: DataFrame
    prior: float


def train_url_filter(labelled: DataFrame, most: int = 20000, folds: int = 4, doubt: float = 0.3, seed: int = 1) -> UrlModel:
    """Fit on ``labelled(url, bad)``, where ``bad`` is 1, 0 or, for URLs of which nothing is known, null.

    Trees are fitted on at most ``most`` URLs, those that hash smallest, of no more than 2048 characters (the documented bounds). Suffix statistics
    count all URLs, but none of a training URL's own fold: for one half of the URLs that is a fold of hosts, as if the host were new, for the
    other a fold of URLs, as if the host were known. URLs without a label stand as good in a first fit, each judged by trees that saw no
    host of its fold; those that then look bad by ``doubt`` or more are no examples in the second.
    """
    fold = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(folds)).cast("int")
    rows = labelled.where("url is not null").groupBy("url").agg(F.max("bad").alias("label"))
    rows = rows.select("url", host_of(F.col("url")).alias("host"), "label", F.coalesce("label", F.lit(0)).alias("bad")).withColumn("fold", fold("host")).withColumn("own", fold("url"))
    names = [f"{kind}{f}" for kind in "hu" for f in range(folds)]
    inside = {f"{kind}{f}": F.col(c) == f for kind, c in (("h", "fold"), ("u", "own")) for f in range(folds)}
    sums = {"n": F.lit(1), "bad": F.col("bad")} | {f"{c}_{x}": F.when(inside[x], v).otherwise(0) for x in names for c, v in (("n", F.lit(1)), ("bad", F.col("bad")))}
    counts = materialize(suffix_counts(rows.groupBy("host").agg(*[F.sum(v).alias(c) for c, v in sums.items()]), list(sums)), "suffixes")
    n, bad = rows.agg(F.count("*"), F.sum("bad")).first()
    prior = ((bad or 0) + 1) / ((n or 0) + 2)
    few = rows.where(F.length("url") <= 2048).orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(most)
    new = F.pmod(F.xxhash64("url", F.lit(seed + 1)), F.lit(2)) == 0
    few = materialize(few.withColumn("out", F.when(new, F.concat(F.lit("h"), "fold")).otherwise(F.concat(F.lit("u"), "own"))), "examples")
    got = few.join(suffix_shares(few, counts, prior, "url", "out"), "url").select("url", "host", path_of(F.col("url")).alias("path"), "label", "bad", "fold", "shares").toPandas().sort_values("url", kind="stable")
    kept = UrlModel(Trees([np.zeros(0)] * 19, -2.0), counts.select("suffix", "n", "bad"), prior)
    if len(got):
        x = matrix(got["host"].tolist(), got["path"].tolist(), got["url"].tolist(), np.stack([np.asarray(s, float) for s in got["shares"]]))
        y, f, unknown = got["bad"].to_numpy(float), got["fold"].to_numpy(), got["label"].isna().to_numpy()
        doubted = np.zeros(len(y), bool)
        if unknown.any() and not unknown.all():
            for k in np.unique(f):
                if (f != k).any():
                    doubted[f == k] = fit_trees(x[f != k], y[f != k]).predict(x[f == k]) >= doubt
        use = ~(unknown & doubted)
        kept.trees = fit_trees(x[use], y[use])
    return kept


def filter_urls(pages: DataFrame, rules: dict[str, str], model: UrlModel, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` for each row; ``rules`` maps ``host/path`` to ``allow`` or ``block``.

    Where no rule fits the verdict is the model's: ``block`` from a score of ``threshold`` on. A null URL, or one without ``://``,
    has an empty host and path and is judged by the model. Null and repeated ids are rows like others; other columns are ignored.
    """
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    src = src.select("_id", F.coalesce("_url", F.lit("")).alias("_url"), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("_path"))
    shares = materialize(suffix_shares(src.select("host").distinct(), model.counts, model.prior), "shares")
    src, trees = src.join(shares, "host"), model.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                c = b.slice(k, 4096)
                known = np.array(c.column("shares").to_pylist(), float)
                p = trees.predict(matrix(*(c.column(x).to_pylist() for x in ("host", "_path", "_url")), known))
                yield pa.RecordBatch.from_arrays([c.column("_id"), c.column("host"), c.column("_path"), pa.array(p)], ["_id", "host", "path", "score"])

    scored = src.select("_id", "host", "_path", "_url", "shares").mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, host string, path string, score double")
    ruled = scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def weak_labels(pages: DataFrame, url_col: str = "url", bad_words: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(url, bad)``: 1 where a word of the host, between dots, hyphens and digits, is one of ``bad_words``, else unknown; URLs without a host are no examples."""
    host = host_of(F.col(url_col))
    words = [w for ws in (BAD_WORDS if bad_words is None else bad_words).values() for w in ws]
    named = F.arrays_overlap(F.split(host, "[^a-z]+"), F.array(*[F.lit(w) for w in words]))
    return pages.where(host != "").select(F.col(url_col).alias("url"), F.when(named, 1).alias("bad"))
