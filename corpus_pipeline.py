"""A corpus pipeline: language, exact copies, near copies, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's
`docs`, so every stage works on all that the one before it kept and a lost executor never reaches back over a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voltable.llm import exact_dedup, language, packing, pii, simhash
from voltable.plans.lineage import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Whole texts go to Python in batches of so many rows: what a task and its worker hold at once beside the work itself.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), whose most likely language has less than half of the
    probability, or that are unlike what was learned of it, go. Null ids and repeated rows stay; no rows give none."""
    small_batches(spark)
    return language.keep_identified(docs, least=0.5, open_set=True)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest stays, then the one with the smallest id, a null id last;
    null texts count as empty; of repeated rows one stays."""
    small_batches(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a similarity of 0.8 or more in shingles of five words, the one with the smallest id stays."""
    small_batches(spark)
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised or removed; `n_chars` follows the text. All rows stay,
    null texts stay null."""
    small_batches(spark)
    clean = pii.sanitise(docs)
    return clean.selectExpr(*("CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`" for c in clean.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens, with the tokens of each piece; null and empty texts are one token."""
    small_batches(spark)
    return packing.pack(docs, VOCABULARY, size=1024, end_id=0, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", sanitise),
    ("packing", pack),
]

#: SQL has no BPE and no SimHash; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
