"""The registered queries of this subpackage: thin calls of its operators with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import ann, bpe, decontaminate, language_id, licenses, near_dedup, pii, quality, rank_bpe, runs, sharding, spelling, token_counts
from strandloom.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return language_id.identify(table(spark, sf_dir, "documents"), learn)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents"))
    return spelling.variants(found.select(spelling.without_one(F.col("run"), F.col("doc_id")).alias("word")))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_licenses, op2_decontaminate, op3_quality, op4_language_id, op5_sharding, op6_near_dedup, op7_pii, op8_nearest, op9_byte_bpe, op10_token_counts, op11_rank_bpe, op12_spelling, op13_runs)}

OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
low AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
twin AS (SELECT w.doc_id, string_agg(s.shingle, chr(10) ORDER BY s.shingle) AS body FROM w JOIN s USING (doc_id) GROUP BY w.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.v, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(low.v, w.doc_id)) AS kept,
  CASE WHEN n.n > 0 THEN min(w.doc_id) OVER (PARTITION BY twin.body) END AS class_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.u = w.doc_id LEFT JOIN twin ON twin.doc_id = w.doc_id
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda s, t: s + t)) AS norm FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    list_reduce(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]), lambda s, t: s + t) / (a.norm * b.norm) AS score
  FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op6_near_dedup": OP6_SQL, "op8_nearest": OP8_SQL}
