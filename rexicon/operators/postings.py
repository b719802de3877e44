"""Postings and their algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the following token that a posting keeps.
NEXT_MASK = 4095
POSTINGS = "token_id int, doc_id long, pos int, next_tok int"


def explode(tokens: DataFrame) -> DataFrame:
    """``doc_id, tokens`` -> one posting per token: ``token_id, doc_id, pos, next_tok`` (0 behind the last)."""
    rows = tokens.select("doc_id", "tokens", F.posexplode("tokens").alias("pos", "token_id"))
    after = F.coalesce(F.get("tokens", F.col("pos") + 1), F.lit(0)).bitwiseAND(F.lit(NEXT_MASK))
    return rows.select("token_id", "doc_id", "pos", after.cast("int").alias("next_tok"))


def sort_postings(postings: DataFrame) -> DataFrame:
    """Globally by bucket, if there is one, token, document and position; a frequent token is spread over tasks."""
    keys = [c for c in ("bucket", "token_id", "doc_id") if c in postings.columns]
    return postings.repartitionByRange(*keys).sortWithinPartitions(*keys, "pos")


def statistics(postings: DataFrame) -> DataFrame:
    """Per token the number of documents and of postings."""
    per = postings.groupBy("token_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_postings"))


def followed_by(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` (``doc_id, pos``) that ``right`` follows: it holds the next position."""
    after = right.select(F.col("doc_id").alias("_d"), (F.col("pos") - 1).alias("_p"))
    return left.join(after, (F.col("doc_id") == F.col("_d")) & (F.col("pos") == F.col("_p")), "left_semi")


def merge_lists(*lists: DataFrame) -> DataFrame:
    """The distinct union of posting lists."""
    return reduce(DataFrame.unionByName, lists).distinct()


def sentence_ids(postings: DataFrame) -> DataFrame:
    """The documents that a list names, each once."""
    return postings.select("doc_id").distinct()
