"""Similarity joins against brute force."""

import numpy as np
import pytest

from larkspan.llm import bucketjoin, embedding_neardup as E, minhash_forest as M, ngram_join as N
from larkspan.llm.components import connected_components
from tests.llm.helpers import LONG, components, cosine_links, jaccard_links

VEC = "vec_id long, embedding array<float>, label int, component_id string, rep string"


def expected(ids, links):
    comp = components(ids, links)
    return {i: (sum(i in p for p in links), comp[i], i == comp[i]) for i in ids}


def vectors(seed, groups=6, size=40, noise=0.02, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(size):
            v = c + rng.standard_normal(dim) * noise * (1 + g % 3)
            out.append((len(out), g % 2, (v / np.linalg.norm(v)).tolist()))
    return out


def run1(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, "x", "y") for i, lab, v in rows], VEC)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_near_duplicates(df, **kw).collect()}


def test_e8_decodes_to_the_nearest_point():
    rng = np.random.default_rng(1)
    x, near = rng.standard_normal((200, 8)) * 3, E.e8_neighbours()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(1), 2)
    c = E.decode_e8(x)
    d = ((x - c) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()  # covering radius
    assert (d[:, None] <= ((x[:, None, :] - c[:, None, :] - near[None]) ** 2).sum(2) + 1e-9).all()


def test_embeddings_match_brute_force(spark):
    rows = vectors(3)
    rows = [(i, lab, np.array(v, np.float32).tolist()) for i, lab, v in rows]
    links = cosine_links(rows)
    assert len(links) > 100
    assert run1(spark, rows) == expected([r[0] for r in rows], links)


def test_embeddings_odd_rows(spark):
    v, w = [1.0, 0.0, 2.0], [1.0, 0.01, 2.0]
    rows = [(5, 1, v), (2, 1, v), (9, 1, w), (7, 2, v), (8, None, v), (10, 1, None), (11, 1, []), (12, 1, [0.0, 0.0, 0.0]), (13, 1, [1.0, None, 2.0]), (14, 1, [1.0, float("nan"), 2.0]), (15, 1, [1.0, float("inf"), 2.0]), (16, 1, [1.0, 0.0]), (17, 2, [3e38, 0.0, 3e38]), (18, 2, [1e-30, 0.0, 1e-30])]
    got = run1(spark, [*rows, (5, 1, v), (None, 1, v)])
    assert got == expected([r[0] for r in rows], cosine_links([(i, lab, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for i, lab, x in rows]))
    assert got[2] == (2, 2, True) and got[17][0] == 1 and got[8] == (0, 8, True)
    assert run1(spark, []) == {}


@pytest.mark.parametrize("rows", [1 << 7, 1 << 13, 1 << 24, 1 << 32])
def test_plans_meet_the_recall_and_stay_selective(rows):
    """Pairs at the threshold, in 64 dimensions, against what the plan promises; unrelated vectors met by a row do not grow with the rows."""
    plan = E.plan_tables(rows, 0.98, 1e-7)
    rng, n = np.random.default_rng(rows), 600
    u, w = rng.standard_normal((2, n, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(1)[:, None] * u
    v = 0.98 * u + np.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1)[:, None]
    a, b = (E.lattice_keys(x, np.zeros(n), plan, 17).reshape(n, plan.tables, -1) >> 1 for x in (u, v))
    met = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any(2)
    assert met.any(1).all()
    share = E.recall_of(plan.codes, plan.scale, 0.98)[plan.probes]
    assert abs(met.mean() - share) < 0.05 and (1 - share) ** plan.tables <= 1e-7 * 1.01
    unrelated = rows * plan.tables * (1 + 2 * plan.probes) * (4 * np.pi * plan.scale**2) ** (-4.0 * plan.codes)
    assert unrelated < 8 and plan.tables * (1 + plan.probes) < 700


def test_copies_and_blocks(spark, monkeypatch):
    """A bucket of many items is cut in blocks; counts stay exact, and copies do not become pairs."""
    monkeypatch.setattr(bucketjoin, "BLOCK", 16)
    rng = np.random.default_rng(0)
    base = rng.standard_normal(16)
    rows = [(i, 0, (base + rng.standard_normal(16) * 0.12).tolist()) for i in range(150)] + [(1000 + i, 0, base.tolist()) for i in range(300)]
    rows = [(i, lab, np.array(v, np.float32).tolist()) for i, lab, v in rows]
    assert run1(spark, rows) == expected([r[0] for r in rows], cosine_links(rows))


def run10(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in texts], "doc_id long, text string, rep string, n long")
    return {r.doc_id: (r.n_links, r.class_id, r.kept) for r in N.ngram_jaccard_join(df, **kw).collect()}


def edited(rng, words, k):
    w = list(words)
    for i in rng.choice(len(w), k, replace=False):
        w[i] = f"new{rng.integers(1e9)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [256, 8])
def test_texts_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bucketjoin, "BLOCK", block)
    rng, texts = np.random.default_rng(7), {}
    for _ in range(12):
        w = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 200)))]
        for k in (0, 0, 0, 1, 1, 2, 3, 4):
            texts[len(texts)] = edited(rng, w, k)
    links = jaccard_links(texts)
    assert len(links) > 100
    assert run10(spark, list(texts.items())) == expected(list(texts), links)


def test_texts_odd_rows(spark):
    texts = {1: None, 2: "", 3: " \n\t", 4: "one two", 5: "One, two!", 6: "one two three four five", 7: "one two three four five", 8: LONG, 9: LONG + "abc", 10: "été Été " * 20, 11: "ÉTÉ été " * 20, 12: "...", 13: "two"}
    got = run10(spark, [*texts.items(), (4, "one two"), (None, "one two")])
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[6] == (1, 6, True) and got[8] == (1, 8, True) and got[9] == (1, 8, False) and got[10][0] == 1
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 12, 13)) and len(got) == 13
    assert run10(spark, []) == {}


def test_the_shortest_prefix_meets_the_recall():
    for trees in (8, 16, 32):
        d = M.shortest_depth(0.8, trees, 12, 0.999)
        assert 1 - (1 - 0.8**d) ** trees >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** trees


def node(hi, lo, depth):
    return M._cut(np.array([hi]), np.array([lo]), depth)[0][0], M._cut(np.array([hi]), np.array([lo]), depth)[1][0], depth


@pytest.mark.parametrize("partitions", [1, 7])
def test_matched_prefixes_match_brute_force(spark, partitions):
    """Sizes of all nodes, counted one by one; nodes lie across partitions."""
    rng = np.random.default_rng(partitions)
    rows = []
    for rep in range(400):
        levels = rng.integers(0, 2, 6) if rep < 300 else rng.integers(0, 1 << 14, 6)
        hi = lo = 0
        for d, level in enumerate(levels):
            if d < 4:
                hi |= int(level) << 14 * (3 - d)
            else:
                lo |= int(level) << 14 * (7 - d)
        rows.append((hi, lo, rep, 1))
    sizes = {}
    for hi, lo, *_ in rows:
        for d in (4, 5, 6):
            sizes[node(hi, lo, d)] = sizes.get(node(hi, lo, d), 0) + 1
    want = {}
    for hi, lo, rep, _ in rows:
        if sizes[node(hi, lo, 4)] > 1:
            want[rep] = next((d for d in (4, 5, 6) if sizes[node(hi, lo, d)] <= 5), 6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.rep: r.depth for r in M.matched_prefixes(spark.createDataFrame(rows, "hi long, lo long, rep long, weight long"), 4, 6, 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and len(set(want.values())) > 1


def test_crowded_prefixes_stay_long_as_far_as_the_recall_allows(spark):
    """Item 0 and 40 others share one tree's node: it stays long. Items 100 and up share nodes in all trees: these are shortened."""
    rng, rows = np.random.default_rng(3), []

    def put(rep, tree, crowd):
        first = [7] * 5 if crowd else rng.integers(0, 1 << 14, 5).tolist()
        hi, last = tree << 56, int(rng.integers(0, 1 << 14))
        for d in range(4):
            hi |= int(first[d]) << 14 * (3 - d)
        rows.append((hi, int(first[4]) << 42 | last << 28, rep, 1))

    for rep in range(40):
        for tree in range(20):
            put(rep, tree, tree == 0)
            put(100 + rep, tree, tree > 4)
    found = M.forest(spark.createDataFrame(rows, "hi long, lo long, rep long, weight long"), 20, 6, 0.8, 0.9999, room=10).collect()
    depths = {}
    for r in found:
        depths.setdefault(r.rep, {})[r.hi >> 56] = r.depth
    assert all(depths[rep] == {0: 6} for rep in range(40))
    assert all(set(depths[rep].values()) == {4} and len(depths[rep]) == 15 for rep in range(100, 140))
    gain = {d: -np.log1p(-(0.8**d)) for d in (4, 5, 6)}
    for rep, ds in depths.items():
        assert sum(gain[d] for d in ds.values()) + (20 - len(ds)) * gain[4] >= -np.log(1e-4)


def test_crowds_of_texts_lose_no_link(spark):
    """Pages of one template: most shingles are common, so nodes are crowded."""
    rng, texts = np.random.default_rng(9), {}
    frame = [f"t{i}" for i in range(60)]
    for i in range(160):
        own = [f"o{x}" for x in rng.integers(0, 10**6, int(rng.integers(4, 25)))]
        texts[i] = " ".join(frame + own)
        if i % 8 == 0:
            texts[1000 + i] = edited(rng, frame + own, 1)
    links = jaccard_links(texts)
    assert run10(spark, list(texts.items()), room=3) == expected(list(texts), links)


def thue_morse(k):
    w = "a"
    for _ in range(k):
        w += w.translate(str.maketrans("ab", "ba"))
    return w


@pytest.mark.parametrize("k", [10, 11, 13])
def test_words_that_defeat_polynomial_hashes(spark, k):
    a = thue_morse(k)
    b = a.translate(str.maketrans("ab", "ba"))
    got = run10(spark, [(1, a), (2, b), (3, a)])
    assert got == {1: (1, 1, True), 2: (0, 2, True), 3: (1, 1, False)}


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 100)]
    want = components({x for p in pairs for x in p}, [p for p in pairs if p[0] != p[1]])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*pairs, (None, 3), (5, 5)], "u long, v long")).collect()}
    assert all(want[n] == c for n, c in got.items()) and set(got) >= {n for n, c in want.items() if n != c}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
