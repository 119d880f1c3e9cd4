"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import ann_forest, bpe, embedding_neardup, line_dedup, mixing, ngram_join, quality_crf, toxicity, url_filter, warc
from larkspan.llm.scratch import new_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.embedding_near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(_read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann_forest.search(vectors, vectors.where("vec_id % 20 = 0"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3.0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, _read(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoding_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality_crf.train_quality(docs, labels.where(~held_out))
    out = quality_crf.score_quality(docs, model, threshold=0.7)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


#: The rules of the URL query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train_url_filter(url_filter.weak_labels(pages))
    return url_filter.filter_urls(pages, URL_RULES, model)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return line_dedup.digests(docs)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_neardup, op2_warc, op3_ann_forest, op4_mix_sources, op5_toxicity, op6_bpe, op7_quality_crf, op8_url_filter, op9_line_dedup, op10_ngram_join)}

_LINK_SQL = """
, reach(node, peer) AS (
  SELECT a, a FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.peer = l.a
)"""

ORACLES = {
    "op1_embedding_neardup": """
WITH RECURSIVE vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
nodes AS (SELECT DISTINCT vec_id AS a FROM vecs),
good AS (SELECT * FROM vecs WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98)""" + _LINK_SQL + """
SELECT n.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = n.a) AS n_links,
  (SELECT min(peer) FROM reach r WHERE r.node = n.a) AS component_id,
  n.a = (SELECT min(peer) FROM reach r WHERE r.node = n.a) AS kept FROM nodes n""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM d""",
    "op9_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
ls AS (SELECT rid, doc_id, i, ls[i] AS line FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
ks AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM ls),
lost AS (SELECT k, max(doc_id) AS top FROM ks WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT ks.*, lost.k IS NOT NULL AND doc_id <> top AS gone FROM ks LEFT JOIN lost ON ks.k = lost.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id""",
    "op10_ngram_join": r"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
nodes AS (SELECT DISTINCT doc_id AS a FROM ws),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM ws WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE x.c >= 0.8 * (na.n + nb.n - x.c) - 1e-9)""" + _LINK_SQL + """
SELECT n.a AS doc_id, (SELECT count(*) FROM links l WHERE l.a = n.a) AS n_links,
  (SELECT min(peer) FROM reach r WHERE r.node = n.a) AS class_id,
  n.a = (SELECT min(peer) FROM reach r WHERE r.node = n.a) AS kept FROM nodes n""",
}
