"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result and reads it back for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from starlattice.llm import bpe, common, dedup, language, mixing, ngram_join


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined (null text or no letter) go; all others stay as they are."""
    labelled = docs.filter(common.fold(docs["doc_id"], 5) != 0)
    found = language.predict(docs, language.fit(labelled), keep=docs.columns)
    return found.filter(found["_lang"] != language.UNDETERMINED).drop("_lang", "_score")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more the one with the smallest doc_id stays."""
    return ngram_join.one_per_class(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source rate, dealt out globally; a document may stay out or come several times."""
    return mixing.mix(docs).select("_row.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy: doc_id, n_tokens, ids_sha256, decoded_sha256 (see bpe for the ids themselves)."""
    return bpe.encode_documents(docs, digests=True)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("poisson_mix", mix_stage),
    ("bpe_tokens", tokens_stage),
]

#: SQL cannot express the language and tokeniser stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is a Parquet table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    home = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
