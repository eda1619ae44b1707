"""Scoring requests end to end, and as a function for SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features, transport
from . import knn

#: Reference vectors that a score function may carry to the executors; more are searched where they are by evaluated().
MOST_CARRIED = 2_000_000


def score_requests(requests: DataFrame, references: DataFrame, k: int = knn.K) -> DataFrame:
    """requests: (qid, body). qid, fraud, cnt, fraud_score, approved, response for each."""
    featured = features.with_features(features.parse(requests.select("qid", "body")))
    queries = featured.select("qid", features.vector_of(featured).alias("q"))
    out = knn.scored(queries, knn.exact(queries, references, k))
    return out.withColumn("response", transport.response(F.col("approved"), F.col("fraud_score")))


def carried(references: DataFrame) -> bool:
    """Whether a score function may carry the references."""
    return references.limit(MOST_CARRIED + 1).count() <= MOST_CARRIED


def evaluated(queries: DataFrame, references: DataFrame, k: int = knn.K) -> DataFrame:
    """qid, fraud_score, err for each of queries (qid, q; each qid once), like the score function, but for any number of references: they stay where they are."""
    out = knn.scored(queries, knn.exact(queries, references, k))
    return out.select("qid", "fraud_score", F.when(F.col("cnt") == 0, 1).otherwise(0).alias("err"))


def score_function(references: DataFrame, k: int = knn.K):
    """A vectorised function from an int16 vector to (fraud_score, err): err 1 without references. The references' number is checked before they are carried."""
    if not carried(references):
        raise ValueError(f"more than {MOST_CARRIED} references: use evaluated() instead")
    rows = references.select("idx", F.col("q").cast("array<int>").alias("q"), "is_fraud").orderBy("idx").toArrow().combine_chunks()
    table = rows["q"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(rows), -1 if len(rows) else 0)
    held = references.sparkSession.sparkContext.broadcast(knn.Tree(table, rows["idx"].to_numpy().astype(np.int64), rows["is_fraud"].to_numpy().astype(bool), k))

    @F.pandas_udf("fraud_score double, err int")
    def score_eval(q: pd.Series) -> pd.DataFrame:
        tree = held.value
        if not len(tree.x):
            return pd.DataFrame({"fraud_score": np.zeros(len(q)), "err": np.ones(len(q), np.int32)})
        dist, _, fraud = tree.search(np.array(q.tolist(), np.float64).reshape(len(q), -1), knn.nothing(len(q), k))
        there = np.isfinite(dist)
        return pd.DataFrame({"fraud_score": (fraud & there).sum(1) / there.sum(1), "err": np.zeros(len(q), np.int32)})

    return score_eval


def register(spark, references: DataFrame, name: str = "score_eval") -> None:
    spark.udf.register(name, score_function(references))


def ready(index: DataFrame | None) -> bool:
    """Whether there is an index with at least one vector."""
    return index is not None and index.limit(1).count() > 0
