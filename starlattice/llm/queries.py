"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, dedup, forest, language, lattice, mixing, ngram_join, pii, sharding
from .common import fold, table


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op2_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every repaired conversation."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law bytes: after the rebalancing edit of the slot map the 16 shards are near-equal in bytes."""
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0 and predicts every row from its text alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 5) == 0
    model = language.fit(docs.filter(~held))
    found = language.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"))


def op6_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), digests=True)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.assignments(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS rn FROM d
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per copy: doc_id, source, rate, copies, copy_no."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), F.round("_rate", 6).alias("rate"), F.col("_copies").cast("long").alias("copies"), F.col("_copy").cast("long").alias("copy_no"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS b FROM documents
), s AS (
  SELECT source, sum(b) AS sb FROM d GROUP BY source
), r AS (
  SELECT source, round(pow(sb::DOUBLE, 0.7) / sum(pow(sb::DOUBLE, 0.7)) OVER () * sum(sb) OVER () / sb, 9) AS rate FROM s
), m AS (
  SELECT d.doc_id, d.source, r.rate, greatest(ceil(r.rate / 8), 1)::BIGINT AS draws FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), j AS (
  SELECT doc_id, source, rate, rate / draws AS mean, unnest(range(1, draws + 1)) AS j FROM m
), u AS (
  SELECT *, (('0x' || substr(sha256('42:' || doc_id || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM j
), k AS (
  SELECT doc_id, source, rate, j, max(u) AS u, max(mean) AS mean FROM u GROUP BY ALL
), steps AS (
  SELECT k.*, n, sum(exp(-mean + n * ln(mean) - lgamma(n + 1))) OVER (PARTITION BY doc_id, j ORDER BY n) AS cdf
  FROM k, range(0, 48) AS t(n)
), c AS (
  SELECT doc_id, source, rate, sum(CASE WHEN cdf < u THEN 1 ELSE 0 END)::BIGINT AS copies FROM steps GROUP BY doc_id, source, rate
)
SELECT doc_id, source, round(rate, 6) AS rate, copies, unnest(range(1, copies + 1))::BIGINT AS copy_no FROM c WHERE copies > 0
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).drop("row_key")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    q.__name__: q
    for q in (op1_prefix_forest, op2_role_repair, op3_virtual_slots, op4_language_id, op5_lattice_lm, op6_speculative_bpe, op7_exact_dedup, op8_pii, op9_poisson_mix, op10_ngram_join, pipeline)
}
ORACLES = {"op7_exact_dedup": OP7_SQL, "op9_poisson_mix": OP9_SQL}
