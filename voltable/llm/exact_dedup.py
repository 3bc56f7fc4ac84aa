"""Exact deduplication in two passes with a Bloom filter, in DataFrame operations only.

First pass: every text's hash becomes a pattern, a block number and a few bits in a 64-bit block, and all rows are grouped
by it (12 bytes a row are shuffled). Patterns met again fill a Bloom filter of possibly repeated hashes. Second pass: each
row asks the filter; those it does not know are unique for certain and pass straight through, only the rest is shuffled and
compared by SHA-256, so a false positive costs a little time and never changes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltable.llm import bloom
from voltable.llm.joins import unused
from voltable.plans.lineage import materialize


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _first(length: Column, key: Column) -> Column:
    """What the row that stays has the least of: the longest text, then the smallest id, ids before null."""
    return F.struct(-length, key.isNull(), key)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal when they are the same without ASCII white space; a null text counts as empty. Of equal texts the row
    with the longest original text stays, then the smallest id; a null id comes last. Repeated rows each count in
    `group_size` and share `keep_id`. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = materialize(docs.select(F.col(id_col).alias("_id"), F.length(text).alias("_length"), F.sha2(normalised(text).cast("binary"), 256).alias("_sha")), "hashes")
    once, maybe = bloom.ask(digest, "_sha", materialize(bloom.repeated(digest, "_sha"), "filter"))
    found = maybe.groupBy("_sha").agg(F.min(_first(F.col("_length"), F.col("_id"))).alias("_least"), F.count("*").alias("group_size"))
    # a written table on this side lets the join split a hash that very many rows have
    found = materialize(found.select(F.col("_sha").alias("_key"), F.col("_least").getField("_id").alias("keep_id"), "group_size"), "groups")
    several = maybe.join(found, F.col("_sha") == F.col("_key"))
    out = [F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256")]
    alone = once.withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("bigint")})
    return alone.select(*out).unionByName(several.select(*out))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; exactly one row of each group, also of repeated rows.

    Rows that are unique for certain are not shuffled; of the others, each task first keeps one row per hash.
    """
    text, sha, row = F.coalesce(F.col(text_col), F.lit("")), unused(docs, "_sha"), unused(docs, "_row")
    hashed = docs.withColumn(sha, F.sha2(normalised(text).cast("binary"), 256))
    once, maybe = bloom.ask(hashed, sha, materialize(bloom.repeated(hashed, sha), "filter"))
    stays = maybe.groupBy(sha).agg(F.min_by(F.struct(*docs.columns), F.struct(-F.length(text), F.col(id_col).isNull(), F.col(id_col))).alias(row))
    return once.select(*docs.columns).unionByName(stays.select(f"{row}.*"))
