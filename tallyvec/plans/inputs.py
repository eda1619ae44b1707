"""The driver's tables as inputs of the engine: labelled vectors, transactions, logs.

Vectors: the first 14 values of `embeddings`; labels under 3 are fraud. Searches take every row whose id is divisible by
100 as a query against all rows. Transactions, requests and log lines are made from `events` by the rules below, the
same ones as in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features, vectors

MCC = {"click": "5411", "view": "58-12", "signup": "5912", "purchase": "7801", "error": "MCC 7995"}
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark, sf_dir: str) -> DataFrame:
    """idx, v, q, is_fraud of every embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), vectors.vector(F.col("embedding")).alias("v"), (F.col("label") < 3).alias("is_fraud"))
    return rows.withColumn("q", vectors.vector_i16(F.col("v")))


def vector_queries(spark, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where("idx % 100 = 0").select(F.col("idx").alias("qid"), "q")


def events(spark, sf_dir: str) -> DataFrame:
    """events with ts as timestamp and k, the number in props."""
    return prepared(table(spark, sf_dir, "events"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with this column, computed once a row: Catalyst copies a projected expression to wherever it is used, but not a generated one."""
    return rows.select(*(c for c in rows.columns if c != name), F.explode(F.array(value)).alias(name))


def prepared(rows: DataFrame) -> DataFrame:
    return _once(rows.withColumn("ts", F.col("ts").cast("timestamp")), "k", F.from_json("props", "k int")["k"])


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def transactions(spark, sf_dir: str) -> DataFrame:
    """Dealt over all cores: the table may be one file that a single task would read, and bodies cost far more than their shuffle."""
    return transactions_of(table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism, "event_id"))


def transactions_of(rows: DataFrame) -> DataFrame:
    """qid, body (the JSON payload) and event_type; rows may be a stream."""
    e = prepared(rows)
    k = F.col("k")
    mcc = F.element_at(F.create_map(*(F.lit(x) for p in MCC.items() for x in p)), F.col("event_type"))
    body = F.struct(
        F.struct(F.col("value").alias("amount"), (k % 12 + 1).alias("installments"), iso(F.col("ts")).alias("requested_at")).alias("transaction"),
        F.struct((20 + k).cast("double").alias("avg_amount"), (k % 25).alias("tx_count_24h"), F.when(k % 2 == 0, F.array(F.lit("click"), F.lit("view"))).otherwise(F.array(F.lit("purchase"))).alias("known_merchants")).alias("customer"),
        F.struct(F.when(k % 11 != 0, F.col("event_type")).alias("id"), F.when(k % 7 != 0, mcc).alias("mcc"), (10 + k * 3).cast("double").alias("avg_amount")).alias("merchant"),
        F.struct((k % 2 == 0).alias("is_online"), (k % 3 == 0).alias("card_present"), (k * 10.5).alias("km_from_home")).alias("terminal"),
        F.when(k % 4 != 0, F.struct(iso(F.expr("ts - make_interval(0, 0, 0, 0, 0, k * 3, 37)")).alias("timestamp"), (k * 2.25).alias("km_from_current"))).alias("last_transaction"),
    )
    return _once(e, "body", F.to_json(body)).select(F.col("event_id").alias("qid"), "body", "event_type")


def featured(spark, sf_dir: str) -> DataFrame:
    return features.with_features(features.parse(transactions(spark, sf_dir)))


def event_vectors(spark, sf_dir: str) -> DataFrame:
    """idx, q, is_fraud of every transaction; errors are fraud."""
    rows = featured(spark, sf_dir)
    return rows.select(F.col("qid").alias("idx"), features.vector_of(rows).alias("q"), (F.col("event_type") == "error").alias("is_fraud"))


def http_requests(spark, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf_dir).select(
        "event_id",
        F.when(k % 5 == 0, "GET").when(k % 7 == 0, "PUT").otherwise("POST").alias("method"),
        F.when(k % 10 == 0, "/ready").when(k % 13 == 0, "/other").otherwise("/fraud-score").alias("path"),
        (k % 17 != 0).alias("header_ends"),
        F.when(k % 19 == 0, 0).when(k % 23 == 0, 70000).otherwise(300 + k).alias("length"),
        F.when(k % 29 == 0, 100).otherwise(300 + k).alias("body"),
    )


def access_lines(spark, sf_dir: str) -> DataFrame:
    """line_no, value: two lines for each request id; every 31st k gives a line that doesn't match."""
    k = F.col("k")
    value = F.format_string("lb[1]: req_id=r%d fe be st=%d Tq=%d Tw=%d Tc=%d Tr=%d Tt=%d", F.floor(F.col("event_id") / 2), F.when(k % 9 == 0, 503).otherwise(200), k % 5, k % 8 - 1, F.lit(1), k % 40, k % 40 + k % 8 + 3)
    lines = _once(events(spark, sf_dir).drop("value"), "line", F.when(k % 31 == 0, F.lit("lb[1]: health check")).otherwise(value))
    return lines.select(F.col("event_id").alias("line_no"), F.col("line").alias("value"))


def trace_lines(spark, sf_dir: str) -> DataFrame:
    """source, line_no, value: events of odd number are from the second server; every 17th k is malformed, every 6th has no t_eval_us, every 37th no request id."""
    k = F.col("k")
    parts = [F.lit('srv {"kind":"req_trace"'), F.when(k % 37 != 0, F.format_string(',"req_id":"r%d"', F.floor(F.col("event_id") / 3))).otherwise(""), F.format_string(',"t_read_us":%d,"t_parse_us":%d', k * 3, k * 7 + 11), F.when(k % 6 != 0, F.format_string(',"t_eval_us":%d', k * 50)).otherwise(""), F.format_string(',"t_resp_us":%d,"t_total_us":%d', k + 5, k * 61 + 16), F.when(k % 17 == 0, "").otherwise("}")]
    lines = _once(events(spark, sf_dir), "line", F.concat(*parts))
    return lines.select((F.col("event_id") % 2).cast("int").alias("source"), F.col("event_id").alias("line_no"), F.col("line").alias("value"))
