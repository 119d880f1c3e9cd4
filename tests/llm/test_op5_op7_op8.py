"""Classifiers: their parts against brute force, held-out accuracy on the test tables."""

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pytest

from larkspan.llm import quality_crf as Q, queries, toxicity as T, url_filter as U
from larkspan.llm.sampling import labelled_rows
from tests.llm.helpers import LONG

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")


#: Words of two kinds of toxic toy texts.
KINDS = (("rude", "nasty", "vile"), ("hateful", "menace", "threat"))


def toy(seed, n=400):
    rng, texts, y = np.random.default_rng(seed), [], []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        kind = i % 4
        if kind == 0:
            w[3] = rng.choice(KINDS[0])
        if kind == 1:
            w[5] = rng.choice(KINDS[1]).upper() + "!"
        texts.append(" ".join(w))
        y.append((kind == 0, kind == 1, kind < 2))
    return texts, np.array(y, int)


def test_chain_learns_and_feeds_on():
    texts, y = toy(1)
    m = T.fit_chain(texts, y, ["insult", "contempt", "toxic"])
    assert [len(w) for w in m.weights] == [len(m.known) + 2 + j for j in range(3)]  # each later model takes the earlier probabilities
    more, want = toy(2, 200)
    p = m.probabilities(m.matrix(pa.array(more)))
    assert p.shape == (200, 3) and ((p >= 0.5) == want).mean() > 0.97
    assert np.allclose(m.probabilities(m.matrix(pa.array(["", None, LONG, texts[0]])))[-1], m.probabilities(m.matrix(pa.array([texts[0]])))[0])


def test_features_are_words_and_beginnings():
    got = {k: (h.tolist(), r.tolist()) for k, h, r in T.word_features(pa.array(["Stupid, stupid stupendous", None, "a"]))}
    h, rows = got[0]
    assert rows == [0, 0, 0, 2] and h[0] == h[1] != h[2]
    assert got[4][1] == [0, 0, 0] and len(set(got[4][0])) == 1 and got[7][1] == [0]


def plain_logistic(x, y, ridge):
    """Gradient ascent to the same optimum."""
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(40000):
        w += 0.002 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - pen * w)
    return w


def test_out_of_fold_feeding_matches_brute_force():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.standard_normal((90, 2)), np.ones(90)])
    y = (x[:, 0] + rng.standard_normal(90) > 0).astype(float)
    want = np.zeros(90)
    for f in range(3):
        inside = [i for i in range(90) if i % 3 != f]
        w = plain_logistic(x[inside], y[inside], 0.5)
        for i in range(f, 90, 3):
            want[i] = 1 / (1 + np.exp(-x[i] @ w))
    got = T.out_of_fold(x, y, 3, 0.5)
    assert np.abs(got - want).max() < 1e-2
    # a row's own label does not reach its own probability
    y[0] = 1 - y[0]
    assert np.isclose(T.out_of_fold(x, y, 3, 0.5)[0], got[0]) and not np.isclose(T.out_of_fold(x, y, 3, 0.5)[1], got[1])


def test_later_models_learn_from_out_of_fold_probabilities():
    texts, y = toy(7, 120)
    m = T.fit_chain(texts, y, ["a", "b", "c"], features=20, folds=4, ridge=0.3)
    x = m.matrix(pa.array(texts))
    fed = [T.out_of_fold(x, y[:, 0].astype(float), 4, 0.3)]
    assert np.allclose(m.weights[1], T.fit_logistic(np.column_stack([*fed, x]), y[:, 1].astype(float), 0.3))
    fed.append(T.out_of_fold(np.column_stack([*fed, x]), y[:, 1].astype(float), 4, 0.3))
    assert np.allclose(m.weights[2], T.fit_logistic(np.column_stack([*fed, x]), y[:, 2].astype(float), 0.3))


def test_kinds_are_found_in_the_sample():
    texts, y = toy(5, 800)
    got = T.split_kinds(texts, y[:, 2].astype(bool), 2)
    assert (got[:, 2] == y[:, 2]).all() and (got[:, :2].sum(1) == y[:, 2]).all() and got[:, :2].any(0).all()
    assert T.split_kinds([], np.zeros(0, bool), 2).shape == (0, 3) and not T.split_kinds(["x"], np.zeros(1, bool), 2).any()


def test_chain_without_examples():
    m = T.fit_chain([], np.zeros((0, 3)), ["a", "b", "c"])
    assert m.probabilities(m.matrix(pa.array(["x", ""]))).shape == (2, 3)
    one = T.fit_chain(["fine text"], np.zeros((1, 3)), ["a", "b", "c"])
    assert (one.probabilities(one.matrix(pa.array(["x"]))) < 0.5).all()


def test_toxicity_rows(spark):
    texts, y = toy(3)
    m = T.fit_chain(texts, y, ["insult", "contempt", "toxic"])
    df = spark.createDataFrame([(1, "you rude w1 w2", 0.1), (None, "w1 w2 w3", 0.2), (3, None, 0.3), (3, "", 0.4), (4, LONG, 0.5)], "doc_id long, text string, score double")
    got = T.score_toxicity(df, m).collect()
    assert [(r.doc_id, r.toxic) for r in got] == [(1, True), (None, False), (3, False), (3, False), (4, False)] and got[0].p_insult > 0.5
    assert T.score_toxicity(df.where("doc_id > 9"), m).count() == 0


@needs_data
def test_toxicity_of_the_tables(spark):
    """Held-out documents; a few toxic labels of the tables stand on texts without any sign."""
    data = DATA.replace("sf0.01", "sf0.1")
    labels, docs = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/documents.parquet")
    m = T.train_toxicity(docs, labels.where("doc_id % 3 != 0"))
    got = T.score_toxicity(docs, m).withColumnRenamed("toxic", "found").join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    bad = [r for r in got if r.toxic]
    assert len(bad) > 100 and sum(r.found for r in bad) >= 0.9 * len(bad)
    assert sum(r.found for r in got if not r.toxic) <= 0.01 * len(got)


def test_training_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 50, "x" * (i % 7 * 100)) for i in range(200)] + [(7, "y" * 2000), (8, None), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(60)] + [(3, 9, 0), (None, 1, 1), (1000, 1, 1)], "doc_id long, toxic int, doc int")
    got = labelled_rows(docs, labels, "doc_id", "text", 20, 1 << 14).collect()
    assert 0 < len(got) <= 20 and sum(len(r.text or "") for r in got) <= 1 << 14 and all(r.toxic == r.doc_id % 2 and len(r.text or "") <= 1 << 10 for r in got)
    assert got and sorted(map(str, got)) == sorted(map(str, labelled_rows(docs.repartition(7), labels, "doc_id", "text", 20, 1 << 14).collect()))
    assert len(labelled_rows(docs, labels, "doc_id", "text", 1000, 1 << 30).collect()) == docs.where("doc_id is not null").distinct().count()


@pytest.mark.parametrize("toxic", [0, 1])
def test_one_class_only(spark, toxic):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", f"{toxic} as toxic").union(docs.selectExpr("doc_id", f"{toxic} as toxic")).union(docs.selectExpr("cast(null as long)", "1 - 1").limit(1))
    got = T.score_toxicity(docs, T.train_toxicity(docs, labels)).collect()
    assert len(got) == 20 and all(r.toxic == bool(toxic) for r in got)


def brute_crf(score, pair):
    """Marginals by enumerating all labellings."""
    n, z, good = len(score), 0.0, np.zeros(len(score))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(s for s, v in zip(score, y) if v) + sum(pair[a, b] for a, b in zip(y, y[1:])))
        z += w
        good += w * np.array(y)
    return good / z, np.log(z)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    row, score = np.array([0] * 5 + [1] + [2] * 7), rng.standard_normal(13) * 2
    pair = rng.standard_normal((2, 2))
    good, pairs, log_z = Q.marginals(score, row, pair)
    want = [brute_crf(score[row == r], pair) for r in range(3)]
    assert np.allclose(good, np.concatenate([w[0] for w in want])) and np.allclose(log_z, [w[1] for w in want]) and np.allclose(pairs.sum((1, 2)), [4, 0, 6])


def test_score_gradient_matches_differences():
    rng = np.random.default_rng(2)
    docs, theta, pair = np.array([0, 0, 0, 1, 2, 2]), rng.standard_normal(6), rng.standard_normal((2, 2))
    share = Q.shares(docs, np.array([3.0, 0, 9, 4, 1, 5]))
    score, by_line, by_pair = Q.score_gradient(theta, pair, docs, share)

    def brute(theta, pair):
        return np.array([brute_crf(theta[docs == d], pair)[0] @ share[docs == d] for d in range(3)])

    assert np.allclose(score, brute(theta, pair))
    for i in range(6):
        step = np.eye(6)[i] * 1e-4
        assert np.isclose(by_line[i], (brute(theta + step, pair) - brute(theta - step, pair))[docs[i]] / 2e-4, atol=1e-5)
    for i, j in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-4
        assert np.allclose(by_pair[:, i, j], (brute(theta, pair + step) - brute(theta, pair - step)) / 2e-4, atol=1e-5)


def test_line_labels_are_found_without_being_told():
    """Only documents are labelled; documents made of a good and a bad half get both labels."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8))))
    good = lambda: " ".join(word() for _ in range(int(rng.integers(8, 14)))).capitalize() + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(int(rng.integers(8, 14))))
    texts, y = [], []
    for i in range(200):
        n, share = int(rng.integers(2, 9)), 0.9 if i % 2 else 0.1
        texts.append("\n".join(good() if rng.random() < share else bad() for _ in range(n)))
        y.append(i % 2)
    m = Q.fit_texts(texts, np.array(y))
    halves = ["\n".join([good() for _ in range(5)] + [bad() for _ in range(5)]) for _ in range(20)]
    got = m.lines(pa.array(halves))[0].reshape(20, 10) > 0.5
    assert got[:, :5].mean() > 0.9 and got[:, 5:].mean() < 0.1
    p = m.score(pa.array(halves))
    sizes = [(sum(map(len, t.split("\n")[:5])), sum(map(len, t.split("\n")))) for t in halves]
    assert np.allclose(p, [a / b for a, b in sizes], atol=0.15)  # weighted by length


def test_features_do_not_depend_on_pieces():
    col = pa.array(["Some Words and words, 12!!\n\n|| x" * 20, "", None, "y" * 300, "a b\n" * 40])
    a, b = Q.line_features(col), Q.line_features(col, most=37)
    assert all(np.allclose(x, y) for x, y in zip(a, b))


def test_neighbours_pull_a_line():
    m = Q.QualityCrf(np.zeros(1), np.ones(1), np.ones(1), np.array([[2.0, -2.0], [-2.0, 2.0]]))
    among_good = Q.marginals(np.array([3.0, -1.0, 3.0]), np.zeros(3, int), m.pair)[0]
    alone = Q.marginals(np.array([-1.0]), np.zeros(1, int), m.pair)[0]
    assert among_good[1] > 0.5 > alone[0]


def test_line_features():
    x, row, size = Q.line_features(pa.array(["ab Cd!!\n\n|| 12", "", None, "x"]))
    assert row.tolist() == [0, 0, 0, 1, 2, 3] and size.tolist() == [7, 0, 5, 0, 0, 1] and np.isfinite(x).all()
    assert x[0, :7].round(3).tolist() == [round(3 / 7, 3), round(1 / 7, 3), 0, 0, 0, round(2 / 7, 3), 0]
    y = Q.line_features(pa.array(["The The The x"]))[0]
    assert y[0, 7] == 0.5 and y[0, 8] == 0.5  # repeated at once, distinct share


def test_quality_rows(spark):
    texts = ["Good plain line of words.\nAnother good line here."] * 30 + ["BAD!! WORSE!!\n$$$ ### ***"] * 30
    m = Q.fit_texts(texts, np.arange(60) < 30)
    df = spark.createDataFrame([(1, texts[0], 0.1, 5), (2, texts[-1], 0.1, 5), (None, None, 0.1, 5), (2, "", 0.1, 5), (4, LONG + "\n" * 1000, 0.1, 5)], "doc_id long, text string, score double, predicted int")
    got = Q.score_quality(df, m).collect()
    assert [r.doc_id for r in got] == [1, 2, None, 2, 4] and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert got[0].predicted == 1 and got[1].predicted == 0 and np.isclose(got[2].score, got[3].score)
    assert Q.score_quality(df.where("doc_id > 9"), m).count() == 0


@needs_data
def test_quality_of_the_tables(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op7_quality_crf"](spark, DATA).collect() if r.held_out and r.doc_id in labels]
    assert len(got) > 50 and sum(r.predicted == labels[r.doc_id] for r in got) >= 0.95 * len(got)


RULES = queries.URL_RULES


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = [
    "http://a.example.net/en/1", "http://example.net", "http://example.net/", "HTTP://A.Example.COM/de/x?y#z", "http://xexample.com/de/", "http://org/fr/", "http://a.org/frx", "http://a.org/fr/?q=http://b", "nothing", "", None, "http://", "://net/x",
    "http://net?x", "http://a.net\n/x", "http://ÄÖ.net/é", "http://user@host.net:80/x", "http://cheap-pills.example.com/en/1", "http://a.example.com/en/" + "y" * 5000, "http://a.example.com/en/1", "http://a.example.com/en/1", "http://www.cheap-pills.example.org/new?a=1",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    good = [f"http://site{i}.example.com/en/{i}" for i in range(60)]
    bad = [f"http://www.cheap-pills.example.org/x{i}" for i in range(20)]
    m = U.train_url_filter(U.weak_labels(spark.createDataFrame([(u,) for u in good + bad], "url string")))
    got = {r.page_id: r for r in U.filter_urls(df, RULES, m).collect()}
    for i, u in enumerate(URLS):
        h, p = host_path(u)
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, rule(h, p)), u
        assert got[i].verdict == RULES[got[i].rule] if got[i].rule else got[i].verdict in ("allow", "block")
    assert got[21].verdict == "block" and got[19].verdict == "allow"
    assert U.filter_urls(df.where("page_id > 99"), RULES, m).count() == 0
    none = U.train_url_filter(U.weak_labels(df.where("page_id > 99")))
    assert {r.verdict for r in U.filter_urls(df, {}, none).collect()} == {"allow"}


def test_suffix_shares_match_brute_force(spark):
    """Counted over all URLs."""
    rng = np.random.default_rng(6)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m.x") for b in ("one", "two", "three") for c in ("com", "org")] + ["com", "bare.org"]
    urls = [(f"http://{h}/{i}", int(rng.random() < (0.9 if "two" in h else 0.1))) for i, h in enumerate(rng.choice(hosts, 300))]
    m = U.train_url_filter(spark.createDataFrame(urls, "url string, bad int"))
    tail = lambda h, k: ".".join(h.split(".")[-k:])
    of = {h: [y for u, y in urls if host_path(u)[0] == h] for h in hosts}
    below = lambda s: [h for h in hosts if any(tail(h, k) == s for k in (1, 2, 3))]
    prior = (sum(y for _, y in urls) + 1) / 302
    share = lambda ys: (sum(ys) + 5 * prior) / (len(ys) + 5)
    frame = spark.createDataFrame([(h,) for h in [*hosts, "new.host.net"]], "host string")
    got = {r.host: r.shares for r in U.suffix_shares(frame, m.counts, prior).collect()}
    for h in hosts:
        assert np.allclose(got[h], [share([y for x in below(tail(h, k)) for y in of[x]]) for k in (1, 2, 3)])
    assert np.allclose(got["new.host.net"], [prior] * 3)


def test_counts_leave_out_a_fold(spark):
    counts = spark.createDataFrame([("org", 10, 6, 4, 3, 2, 1), ("a.org", 3, 3, 3, 3, 0, 0)], "suffix string, n long, bad long, n_h0 long, bad_h0 long, n_u1 long, bad_u1 long")
    rows = spark.createDataFrame([("x", "a.org", "h0"), ("y", "a.org", "u1"), ("z", "b.org", "h1")], "url string, host string, out string")
    got = {r.url: r.shares for r in U.suffix_shares(rows, counts, 0.5, "url", "out").collect()}
    assert np.allclose(got["x"], [(3 + 2.5) / 11, 2.5 / 5, 2.5 / 5]) and np.allclose(got["y"], [(5 + 2.5) / 13, 5.5 / 8, 5.5 / 8]) and np.allclose(got["z"], [8.5 / 15, 0.5, 0.5])


def test_urls_of_unseen_hosts(spark):
    """Bad hosts differ by their looks: digits, hyphens, long paths. Some of them bear no label and stand among the unknown."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    good = lambda h: f"https://{h}/{word()}/{rng.integers(10000)}"
    bad = lambda h: f"http://{h}/{word()}{rng.integers(10**9)}/x?id={rng.integers(10**9)}&ref={rng.integers(10**6)}"
    fair, foul = [f"www.{word()}.example.com" for _ in range(60)], [f"{word()}-{rng.integers(1000, 9999)}.example.com" for _ in range(40)]
    rows = [(good(h), None) for h in fair[:40] for _ in range(10)] + [(bad(h), 1) for h in foul[:20] for _ in range(10)] + [(bad(h), None) for h in foul[20:30] for _ in range(10)]
    m = U.train_url_filter(spark.createDataFrame(rows, "url string, bad int"))
    new = [(i, good(h)) for i, h in enumerate(fair[40:])] + [(100 + i, bad(h)) for i, h in enumerate(foul[30:])]
    got = {r.page_id: r.verdict for r in U.filter_urls(spark.createDataFrame(new, "page_id long, url string"), {}, m).collect()}
    assert sum(v == "allow" for i, v in got.items() if i < 100) >= 19 and sum(v == "block" for i, v in got.items() if i >= 100) >= 9


def test_weak_labels_know_words_not_parts(spark):
    df = spark.createDataFrame([("http://casino-win.example.com/",), ("http://alphabets.example.com/",), ("http://free-bets2.example.com",), ("http://sussex.example.org",), (None,), ("x",)], "url string")
    assert [r.bad for r in U.weak_labels(df).collect()] == [1, None, 1, None]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] > 0.5)).astype(float)
    m = U.fit_trees(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) >= 0.5) == (y[1500:] > 0)).mean() > 0.97
