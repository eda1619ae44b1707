"""Structured Streaming: stateless scoring, and rolling counts with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, into Parquet files at path. In complete mode each batch replaces the last."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()


def score_stream(requests: DataFrame, vector: Callable[[DataFrame], DataFrame], score) -> DataFrame:
    """requests: an unbounded (qid, body). qid, fraud_score, approved; each request on its own, nothing is kept between them."""
    scored = vector(requests).withColumn("s", score(F.col("q")))
    return scored.select("qid", F.col("s.fraud_score").alias("fraud_score"), (F.round(F.col("s.fraud_score") * 5) < 3).alias("approved"))


def score_batches(requests: DataFrame, path: str, checkpoint: str, vector: Callable[[DataFrame], DataFrame], evaluate: Callable[[DataFrame], DataFrame]) -> None:
    """Like score_stream and run_available, where the references are too many to carry: each micro-batch is evaluated (qid, q to qid, fraud_score) as a whole, into a folder of its own under path, which a repeated batch replaces."""

    def scored(batch: DataFrame, number: int) -> None:
        out = evaluate(vector(batch)).select("qid", "fraud_score", (F.round(F.col("fraud_score") * 5) < 3).alias("approved"))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    requests.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(scored).start().awaitTermination()


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """user_id, hour, n, cents: tumbling counts and sums of each user, with state until the watermark passes."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
        .select("user_id", F.col("w.start").alias("hour"), "n", "cents")
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.par[q]uet")
