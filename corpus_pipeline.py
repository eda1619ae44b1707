"""Documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and reads
it again as the next stage's documents. All but the last keep the columns of documents.

Defined results. Rows without a letter, with an empty or with a null text go in the first stage, as they are in no
language. Null ids, repeated ids and repeated rows are documents of their own until near copies go; of those exactly one
row stays, and null ids rank last. Texts may be of any length. An empty table gives no rows in every stage. Further
columns of documents are kept up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvec.llm import decontaminate, langid, line_dedup, ngram_join, packing
from tallyvec.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no language that the labelled ones teach."""
    return langid.reject(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that occurred before, exactly or nearly, and documents of such lines only."""
    left = line_dedup.deduplicate(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_copies), ("decontaminate", benchmark), ("best_fit_packing", pack)]

#: SQL can express neither the learned language models nor SimHash lines; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
