"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, langid, line_dedup, media, ngram_join, oracles, packing, quality, secrets, token_output, urls
from .common import fold, table


def op1_secrets(spark, sf_dir):
    """Secret spans of every document."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op2_line_dedup(spark, sf_dir):
    """Lines before and after fuzzy deduplication of every document."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    """Quality score of every document, learned from four fifths of the labelled ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return quality.classify(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_pack(spark, sf_dir):
    """Every token piece of every document with its place in a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_token_output(spark, sf_dir):
    """Every segment of every document as read back from the written id matrices."""
    return token_output.written_segments(table(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page; `labels` gives the outcome of the page with the same number."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("bound")


def op7_decontaminate(spark, sf_dir):
    """Words, benchmark hits and the contamination verdict of every document."""
    return decontaminate.digest(decontaminate.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_ngram_join(spark, sf_dir):
    """Shingle count and near-duplicate component of every document."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    """The predicted language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    return langid.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_media(spark, sf_dir):
    """Stored media and features of every document, read back from the chunk store."""
    return media.columns(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_line_dedup, op3_quality, op4_pack, op5_token_output, op6_url_filter, op7_decontaminate, op8_ngram_join, op9_language, op10_media, pipeline)}
ORACLE_SQL = {"op6_url_filter": oracles.OP6, "op7_decontaminate": oracles.OP7, "op8_ngram_join": oracles.OP8}
