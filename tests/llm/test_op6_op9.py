"""Encoding against the library, line dedup against brute force."""

import base64
import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from larkspan.llm import bpe, line_dedup as L
from larkspan.llm.textkit import shingles, slices
from tests.llm.helpers import LONG, dedup_lines

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n  x", "It's we'll I'M don't 'd", "é É ñ ß ÄÖ", "日本語テキスト 漢字", "👍🏽 a‍b", "12345 1.5e10 ½ ٣", "a" * 300, "    def f(x):\n\treturn x  \n", "<|endoftext|>", "  x　 y", "tab\there\r\nnew\x0bline\x0c", "mixed123abc_def-ghi", "\x00\x01\x7f", LONG, "ﬁ ǆ ŉ ẞ İ", "zero​width ﻿ bom"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_encoding_matches_the_library(spark, reference):
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.choice((rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x370, 0x1FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0x1F300, 0x1FAFF), 32, 10))) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, "again", "x", 1), (None, "no id", "x", 1)], "doc_id long, text string, chunk string, key int").repartition(3)
    got = {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in bpe.encoding_digests(df, RANKS, tokenizers.PATTERN).collect()}
    assert len(got) == len(texts) + 2
    for i, t in [*enumerate(texts), (3, "again"), (None, "no id")]:
        ids = reference.encode_ordinary(t or "")
        assert got[i, len(ids)] == (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_ids_and_round_trip(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 64)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    enc = bpe.encode_documents(df, RANKS, tokenizers.PATTERN)
    got = {r.doc_id: r.token_ids for r in enc.collect()}
    assert all(got[i] == reference.encode_ordinary(t or "") for i, t in enumerate(TEXTS))
    back = {r.doc_id: bytes(r.text_bytes) for r in bpe.decode_documents(enc, RANKS).collect()}
    assert all(back[i].decode() == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.encode_documents(df.where("doc_id > 999"), RANKS, tokenizers.PATTERN).count() == 0


def test_one_shuffle_serves_words_and_positions(spark):
    df = bpe.encoding_digests(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), RANKS, tokenizers.PATTERN)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().toString()


def test_inputs_with_a_shuffle_are_written_first(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert bpe._settled(df) is df and bpe._settled(df.where("doc_id > 3").select("text", "doc_id")).inputFiles()[0].split(":")[1].lstrip("/").startswith(str(tmp_path)[1:])
    again = bpe._settled(df.repartition(3))
    assert "larkspan-" in again.inputFiles()[0] and again.count() == 50


def test_long_documents_go_through_in_steps(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(bpe, "STEP", 7)
    text = "It's a long text, with words and 12345 numbers. " * 200
    [r] = bpe.encoding_digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, tokenizers.PATTERN).collect()
    ids = reference.encode_ordinary(text)
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_word_owners_depend_on_bytes_only():
    assert bpe.zlib.crc32("é".encode()) == bpe.zlib.crc32(b"\xc3\xa9") and base64.b64encode(b"x")


def random_lines(seed, docs=300):
    rng = random.Random(seed)
    pool = [f"  Shared line number {i} of the pool \t" for i in range(40)] + ["short", "exactly twenty chars", "exactly nineteen ch", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "", " "]
    out = []
    for i in range(docs):
        lines = [rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) if rng.random() < 0.6 else f"own line of text {rng.random()}" for _ in range(rng.randint(0, 12))]
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_lines_match_brute_force(spark, partitions):
    rows = random_lines(partitions) + [(i, "The one line that a third of all documents hold\nown " + str(i)) for i in range(300, 450)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, LONG), (904, LONG), (905, LONG + "\n" + LONG), (None, "The one line that a third of all documents hold"), (906, "The one line that a third of all documents hold\x0c\r\n" * 3), (10, rows[10][1])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, pos int, bitmap binary")
        got = sorted(map(str, ((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in L.digests(L.dedup_lines(df)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for (i, _), (lines, kept) in zip(rows, dedup_lines(rows))]
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("k", [10, 11, 13])
def test_lines_that_defeat_polynomial_hashes(spark, k):
    a = "a"
    for _ in range(k):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, a)]
    got = {r.doc_id: r.n_dropped for r in L.digests(L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: 0, 2: 0, 3: 0}


def test_helper_names_are_free(spark):
    line = "a line that occurs in three documents"
    own = ["_bitmap", "_n_dropped", "_id", "_th", "_h", "h1", "bitmap", "n_dropped", "text_hash", "_bitmap_"]
    df = spark.createDataFrame([(i, f"{line}\n{i}", *[f"{c}{i}" for c in own]) for i in range(4)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in own))
    out = L.dedup_lines(df)
    assert out.columns[:-2] == df.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    assert sorted(out.select(*df.columns).collect()) == sorted(df.collect())
    assert {r.doc_id: r.n_dropped for r in L.digests(out).collect()} == {0: 1, 1: 1, 2: 1, 3: 0}


def test_bitmaps(spark):
    text = "a line that occurs in three documents\nmine"
    df = spark.createDataFrame([(i, text) for i in range(3)] + [(7, "alone")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.line_keep_bitmaps(df).collect()}
    assert set(got) == {0, 1} and got[0].n_lines == 2 and got[0].n_dropped == 1 and L.apply_bitmap(text, bytes(got[0].bitmap)) == "mine"
    assert L.line_keep_bitmaps(df.where("doc_id > 99")).count() == 0
    assert L.digests(L.dedup_lines(df.where("doc_id > 99"))).count() == 0


def test_line_spans():
    data, off = np.frombuffer(b"a\n\nbcx", np.uint8), np.array([0, 5, 5, 6])
    s, e, row, pos = L.line_spans(data, off)
    assert list(zip(s, e, row, pos)) == [(0, 1, 0, 0), (2, 2, 0, 1), (3, 5, 0, 2), (5, 5, 1, 0), (5, 6, 2, 0)]


def test_shingles_do_not_cross_rows():
    h, off = shingles(pa.array(["a b c d e f", "A, b. C d e", None, "a b", ""]))
    assert off.tolist() == [0, 2, 3, 3, 4, 4] and h[0] == h[2] and len(set(h.tolist())) == 3
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 30, "z"])], ["t"])
    assert [p.num_rows for p in slices(b, "t", 12)] == [2, 1, 1]


def test_files_stay_where_they_are():
    assert os.path.exists(RANKS)
