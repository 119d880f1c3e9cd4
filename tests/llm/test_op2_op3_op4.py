"""Archives, neighbours, mixing."""

import base64
import glob
import gzip
import hashlib
import re

import numpy as np
import pytest

from larkspan.llm import ann_forest, mixing, warc
from pyspark.sql import functions as F
from tests.llm.helpers import LONG, mixed, water

PAGES = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, None, None), (4, "http://é b\r\n/x", ""), (5, "http://a/5", LONG + "ü"), (5, "http://a/5", LONG + "ü"), (None, "http://n", "same"), (6, "u", "WARC/1.1\r\n\r\nx\r\n\r\n")]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, tmp_path, compress):
    df = spark.createDataFrame([(*p, "x", 7) for p in PAGES], "page_id long, url string, html string, payload string, first long")
    folder = "file://" + str(tmp_path / "w")
    index = warc.write_warc(df, folder, file_bytes=1000, compress=compress, date="2020-01-01T00:00:00Z")
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(index).collect()]
    first = {}
    for p, _, html in PAGES:
        if p is not None:
            first[html or ""] = min(p, first.get(html or "", p))
    want = []
    for p, _, html in PAGES:
        raw, top = (html or "").encode(), first[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((p, "response" if p == top else "revisit", None if p == top else top, len(raw), digest, raw if p == top else None))
    assert sorted(map(str, got)) == sorted(map(str, want))
    files = glob.glob(str(tmp_path / "w" / "*"))
    whole = b"".join(gzip.decompress(open(f, "rb").read()) if compress else open(f, "rb").read() for f in files)
    assert whole.count(b"WARC-Type: ") == len(PAGES) + len(files) and whole.count(b"WARC-Type: warcinfo") == len(files)
    names = re.findall(rb"WARC-Record-ID: (\S+)", whole)
    assert len(set(names)) == len(names) and whole.count(b"WARC-Refers-To-Target-URI: http://a/2\r\n") == 2
    picked = warc.read_warc(index.where("page_id = 5")).collect()
    assert len(picked) == 2 and all(bytes(r.payload).decode() == LONG + "ü" for r in picked)


def test_warc_notices_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "hello world")], "page_id long, url string, html string")
    index = warc.write_warc(df, "file://" + str(tmp_path / "w"), compress=False)
    f = glob.glob(str(tmp_path / "w" / "*"))[0]
    raw = open(f, "rb").read()
    open(f, "wb").write(raw.replace(b"hello", b"jello"))
    with pytest.raises(Exception, match="digest differs"):
        warc.read_warc(index).collect()


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(df, "file://" + str(tmp_path / "w"))).count() == 0


def vecs(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.5, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score double, shard string")


def brute(rows, asked, k):
    out = {}
    for q, a in asked:
        s = sorted((-float(np.dot(np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float))), i) for i, b in rows if i != q and len(a) == len(b))
        out[q] = [(i, -x) for x, i in s[:k]]
    return out


def test_neighbours_are_exact_where_all_are_candidates(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(16) * (1 + i % 3)).tolist()) for i in range(200)] + [(300, [1.0] * 16), (301, [1.0] * 16)]
    df = vecs(spark, rows)
    got = {}
    for r in ann_forest.search(df, df.where("vec_id % 20 = 0"), shard_rows=64, least=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q]))


def recall(spark, x, every, **kw):
    df = vecs(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    x = np.array(x, np.float32).astype(float)
    got = {}
    for r in ann_forest.search(df, df.where(f"vec_id % {every} = 0"), **kw).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == -(-len(x) // every)
    return hit / (20 * len(got))


@pytest.mark.parametrize("sigma", [0.0, 0.6])
def test_recall_of_the_forest(spark, sigma):
    """Independent Gaussian vectors, the hardest case, of equal and of very unequal lengths."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64))
    x = x / np.linalg.norm(x, axis=1)[:, None] * np.exp(sigma * rng.standard_normal(6000))[:, None]
    assert recall(spark, x, 100) >= 0.9
    assert recall(spark, x, 100, shard_rows=1500) >= 0.9


def clustered(rng, n, size=50):
    centres = rng.standard_normal((n // size, 64))
    return np.repeat(centres, size, axis=0) + 0.3 * rng.standard_normal((n // size * size, 64))


def test_clustered_vectors_need_few_candidates(spark):
    rng = np.random.default_rng(6)
    x = clustered(rng, 8000)
    longest = float(np.linalg.norm(x, axis=1).max())
    ids = np.arange(len(x))
    few = [ann_forest.enough(x[:n], ids[:n], x[:n:97], ids[:n:97], longest, 20, 0.96) for n in (4000, 8000)]
    assert max(few) <= 400  # whatever the number of rows
    assert recall(spark, x, 100) >= 0.9


def test_forest_ascends_to_enough_candidates():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 8))
    f = ann_forest.Forest(x, 6.0, trees=6, bits=12, seed=1)
    for cand in f.candidates(x[:20], 50):
        assert len(cand) >= 50
    assert all(len(c) == 500 for c in f.candidates(x[:3], 500))


def test_candidates_stand_below_the_longest_prefixes():
    """Against prefixes of strings, compared one by one."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 6))
    f = ann_forest.Forest(x, 5.0, trees=4, bits=10, seed=2)
    up = ann_forest.lift(x, 5.0)
    strings = [["".join("1" if v > 0 else "0" for v in u @ p) for u in up] for p in f.planes]
    for q, cand in enumerate(f.candidates(x[:30], 25)):
        mine = ["".join("1" if v > 0 else "0" for v in np.append(x[q], 0.0) @ p) for p in f.planes]
        for level in range(10, -1, -1):
            below = {i for t in range(4) for i in range(200) if strings[t][i][:level] == mine[t][:level]}
            if len(below) >= 25 or not level:
                break
        assert set(cand.tolist()) == below


def test_ties_at_the_last_rank_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(7)
    same = 3 * rng.standard_normal(16)
    rows = [(i, same.tolist()) for i in range(500)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(500)]
    df = vecs(spark, rows)
    got = [r.vec_id for r in ann_forest.search(df, df.where("vec_id = 7"), shard_rows=200).orderBy("rank").collect()]
    assert got == [i for i in range(21) if i != 7]


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 1.0, 1.0]), (20, [0.0, 1.0]), (None, [5.0, 5.0]), (1, [1.0, 0.0])]
    df = vecs(spark, rows)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann_forest.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann_forest.search(df.where("vec_id < 0"), df).count() == 0 and ann_forest.search(df, df.where("vec_id < 0")).count() == 0


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1.0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, key double")


@pytest.mark.parametrize("seed", range(2))
def test_the_choice_of_documents_matches_brute_force(spark, seed):
    """Document by document: by keys, skipping what does not fit, closing with what is nearest."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        s = ["a", "b", "c", None, "e"][int(rng.integers(5))]
        n = int(rng.integers(0, 60)) if s != "c" else int(rng.choice([3, 900]))
        rows.append((i, " ".join(f"w{x}" for x in rng.integers(0, 999, n)) + (" ***" if i % 3 else ""), s))
    docs = documents(spark, rows)
    keys = {r.id: (r.id, r.source, r.size, r.key) for r in mixing.sized(docs, "doc_id", "text", "source").collect()}
    times = mixed(list(keys.values()))
    got = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    assert got == {i: times[i] * keys[i][2] for i in keys}
    out = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    assert sorted(out) == sorted(i for i, n in times.items() for _ in range(n))


def test_sizes_and_prose_of_long_texts():
    from larkspan.llm.textkit import size_and_prose
    import pyarrow as pa

    texts = ["a b  c\n", "", None, LONG, " x" * 50, "é **,\x0b\ty"]
    size, prose = size_and_prose(pa.array(texts))
    assert size.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert np.isclose(prose[5], 1 - 3 / 9) and prose[0] == 1
    for most in (1, 7, 1000):
        a, b = size_and_prose(pa.array(texts[:3] + texts[4:]), most)
        c, d = size_and_prose(pa.array(texts[:3] + texts[4:]))
        assert (a == c).all() and np.allclose(b, d)


def test_quality_may_be_a_column(spark):
    rows = [(i, f"w{i} " * 10, "s", 1.0 if i % 2 else None) for i in range(600)] + [(1000 + i, f"v{i} " * 100, "t", 0.5) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    got = mixing.mix_sources(docs, weights=(1, 30), quality_col="quality").where("doc_id < 1000").collect()
    assert sum(r.taken for r in got if r.doc_id % 2) > 5 * sum(r.taken for r in got if not r.doc_id % 2) > 0
    assert mixing.mixed_documents(docs, weights=(1, 30), quality_col="quality").where("doc_id < 1000").count() == sum(r.taken > 0 for r in got)


def test_mixed_rows_keep_all_their_columns(spark):
    own = ["_key", "_size", "_source", "_epochs", "_runs", "_extra", "_odd", "_odd_source", "_odd_key", "_copy", "_n", "_m", "key", "size", "target"]
    rows = [(i, f"w{i} " * (1 + i % 9), "ab"[i % 2], *[f"{c} {i}" for c in own]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in own))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() > 0 and all(tuple(r) == rows[r.doc_id] for r in out.collect())


def test_mix(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s, n in (("a", 40), ("b", 700), ("é", 300), ("z", 500), (None, 200), ("one", 1)):
        rows += [(len(rows) + i, " ".join(["word"] * int(rng.integers(1, 60))), s) for i in range(n)]
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, " \t\n", "b"), (None, "x y", "b"), (9003, "x\x0by\x0cz w", "z"), (7, "again again", "b"), (7, "again again", "b")]
    docs = documents(spark, rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and docs.columns[0] == "doc_id"
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = {s: 0 for s in sizes}
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
        if r.size:
            assert r.taken // r.size in (int(want[s] // sizes[s]), int(want[s] // sizes[s]) + 1)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60, s
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.expr("regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')"))).first()[0] == sum(taken.values())


def test_quality_weighs_the_draw(spark):
    rows = [(i, ("good words here " if i % 2 else "%%% ### &&& ") * 5, "s" if i < 2000 else "t") for i in range(4000)]
    got = mixing.mix_sources(documents(spark, rows), weights=(1, 3)).where("source_size > 0").collect()
    half = [r for r in got if 0 < r.target < r.source_size]
    taken = [sum(bool(r.taken) for r in half if r.doc_id % 2 == k) for k in (0, 1)]
    # rates 1 and 1/4, half of all taken: 1 - exp(-c) + 1 - exp(-c / 4) = 1 has c = 1.27, so 0.72 and 0.28 of 1000 each
    assert sum(taken) == 1000 and abs(taken[1] - 720) < 40


def test_mix_empty(spark):
    docs = documents(spark, [])
    assert mixing.mix_sources(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    assert mixing.mix_sources(documents(spark, [(1, None, None), (2, "", "a")])).count() == 2


def test_mix_with_a_dominant_document(spark):
    # in each source one document holds 60 %, other sizes are 20 to 40; keys differ by source, so that it comes early and late
    rows, sizes = [], {}
    for k in range(30):
        n = [20 + (7 * i + k) % 21 for i in range(200)]
        n.append(int(1.5 * sum(n)))
        rows += [(len(rows) + i, "w " * w, f"s{k:02d}") for i, w in enumerate(n)]
        sizes[f"s{k:02d}"] = sum(n)
    docs = documents(spark, rows)
    share = [0.1, 0.3, 0.39, 0.45, 0.65, 0.8, 1.3, 1.6]
    weights = spark.createDataFrame([(s, share[i % 8] * sizes[s]) for i, s in enumerate(sizes)] + [("rest", 0.0)], "source string, weight double")
    got = mixing.mix_sources(docs, weights=weights).collect()
    source = {i: s for i, _, s in rows}
    taken, target, big = dict.fromkeys(sizes, 0), {}, {s: 0 for s in sizes}
    for r in got:
        s = source[r.doc_id]
        taken[s], target[s], big[s] = taken[s] + r.taken, r.target, max(big[s], r.size)
    for s in sizes:
        left = target[s] % sizes[s]
        small = sizes[s] - big[s]
        # between all short ones and the long one alone nothing can be had
        best = min(left - small, big[s] - left) if small < left < big[s] else 0
        assert abs(taken[s] - target[s]) <= best + 20, (s, taken[s], target[s], sizes[s])
    n = mixing.mixed_documents(docs, weights=weights).groupBy("source").agg(F.sum(F.expr("regexp_count(text, 'w')")).alias("n"))
    assert {r.source: r.n for r in n.collect()} == {s: t for s, t in taken.items() if t}


def test_mix_takes_equal_rows_together(spark):
    rows = [(i // 2, "w " * (1 + (i // 2) % 40), "s" if i < 1200 else "t") for i in range(2400)]
    docs = documents(spark, rows)
    got = mixing.mix_sources(docs, weights=(1, 3)).collect()
    pairs = {}
    for r in got:
        pairs.setdefault(r.doc_id, set()).add(r.taken)
    assert all(len(v) == 1 for v in pairs.values())
    for t in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == t) - t) <= 1
    assert mixing.mixed_documents(docs, weights=(1, 3)).agg(F.sum(F.expr("regexp_count(text, 'w')"))).first()[0] == sum(r.taken for r in got)
