"""A corpus pipeline of five operators: from ``documents`` to packed training bins.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and
returns a DataFrame; ``run`` writes each stage's rows as Parquet to the shared folder
and reads them again as the next one's docs.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rexicon.llm import linededup, minhash, mixing, packing, toxicity
from rexicon.llm.common import n_words, save, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that earlier documents hold are cut; documents of which nothing is left go."""
    out = linededup.dedup(docs).where((F.col("n_removed") == 0) | (n_words(F.col("text")) > 0))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    return mixing.apply(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_out),
    ("near duplicates", copies_out),
    ("mixing", mixed),
    ("packing", packed),
]

#: Aho-Corasick scores, patience diff and best fit are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
