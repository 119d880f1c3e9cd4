"""The pipeline's stages on small documents, and its parts taken away."""

import os
import subprocess
import sys

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from larkspan.llm import bpe, mixing, stages, toxicity  # noqa: E402
from tests.llm.helpers import components, dedup_lines, jaccard_links, mixed  # noqa: E402

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUDE = ("rude", "nasty", "vile")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120):
    rng, rows, labels = np.random.default_rng(5), [], []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 3000, 60)]
        toxic = i % 6 == 0
        if toxic:
            w[7], w[20] = rng.choice(RUDE), rng.choice(RUDE)
        text = " ".join(w)
        if i % 10 == 3:
            text = rows[i - 1][1]
        if i % 10 == 4:
            text = rows[i - 3][1] + " tail"
        if i % 4 == 1:
            text += "\nAll rights reserved by the owners of this page"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic and i % 10 not in (3, 4))))
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] % 10 not in (3, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "ngram_join", "mix_sources", "bpe"]
    clean = stage["toxicity"](spark, docs, sf_dir)
    bad = {i for i, t, *_ in corpus()[0] if any(w in t.split() for w in RUDE)}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    lines = stage["line_dedup"](spark, clean, sf_dir)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    want = {i: "\n".join(kept) for (i, _), (_, kept) in zip(rows, dedup_lines(rows))}
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns and {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert sum(t.split("\n").count("All rights reserved by the owners of this page") for t in want.values()) == 1
    left = stage["ngram_join"](spark, lines, sf_dir)
    comp = components(want, jaccard_links(want))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, c in comp.items() if i == c} and len(comp) > left.count()
    mixed = stage["mix_sources"](spark, left, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() > 0
    out = stage["bpe"](spark, mixed, sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixed.collect()) and all(r.n_tokens == len(r.token_ids) for r in out.collect())


def test_run_matches_brute_force(spark, sf_dir):
    """All stages in a row, document by document; the classifier's probabilities are taken as they are."""
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = model.probabilities(model.matrix(pa.array([r.text for r in rows.values()])))[:, -1]
    clean = [(i, rows[i].text) for i, x in zip(rows, p) if x < 0.5]
    texts = {i: "\n".join(kept) for (i, _), (_, kept) in zip(clean, dedup_lines(clean))}
    comp = components(texts, jaccard_links(texts))
    texts = {i: t for i, t in texts.items() if comp[i] == i}
    frame = spark.createDataFrame([(i, t, rows[i].source) for i, t in texts.items()], "doc_id long, text string, source string")
    times = mixed([(r.id, r.source, r.size, r.key) for r in mixing.sized(frame, "doc_id", "text", "source").collect()])
    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, own.encode_ordinary(t)) for i, t in texts.items() for _ in range(times[i]))
    assert 0 < len(texts) < len(clean) < len(rows)
    for _ in range(2):  # a run that is repeated gives the same
        out = pipeline.run(spark, sf_dir)
        assert out.columns == ["doc_id", "n_tokens", "token_ids"] and sorted((r.doc_id, r.token_ids) for r in out.collect()) == want


def test_stages_keep_all_columns(spark, sf_dir):
    own = ["_gone", "_hash", "_row", "_n", "_first", "_bitmap", "_n_dropped", "_id", "_th", "_h", "_key", "_size", "_copy", "kept", "rep", "hash", "row", "n", "_gone_"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(c + " "), "doc_id").alias(c) for c in own])
    docs = docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.where("doc_id = 7").withColumn("text", F.lit("another text of this id")))
    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c} {r.doc_id}" for r in got for c in own), name


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, None, "en", None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "x " * 50_000, "en", "a", 100_000), (3, "y", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", rep string")
    for name, f in pipeline.STAGES[:-1]:
        docs = f(spark, docs, sf_dir)
        assert docs.columns[-1] == "rep", name
    empty = spark.createDataFrame([], SCHEMA)
    for _, f in pipeline.STAGES:
        empty = f(spark, empty, sf_dir)
    assert empty.count() == 0


def test_the_rest_works_without_this_subpackage(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('larkspan.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'scan_star' in e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline'], list(e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=REPO)


def test_nothing_else_imports_this_subpackage():
    found = subprocess.run(["grep", "-rlE", "larkspan[.]llm|from larkspan import .*llm", "--include=*.py", "larkspan"], cwd=REPO, capture_output=True, text=True).stdout.split()
    assert found and all(x.startswith("larkspan/llm/") for x in found)


def test_near_duplicates_where_ids_repeat(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, a), (2, a), (3, b), (5, c), (5, b), (6, b + " tail"), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    left = stages.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    # one row of the class of a, one of b, and c, which shares its id with a copy of b; null ids take no part
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, a), (0, a), (1, a), (3, b), (5, c)])
