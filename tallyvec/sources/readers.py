"""Sources and sinks: labelled vectors, requests, logs, the flat binary index."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import vectors


def references_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {vector, label} objects, plain or .gz: idx, v (14 reals), is_fraud."""
    rows = spark.read.schema(schemas.REFERENCES).option("multiLine", True).json(path)
    numbered = rows.withColumn("idx", F.monotonically_increasing_id())
    return numbered.select("idx", vectors.vector(F.col("vector")).alias("v"), F.coalesce(F.col("label") == "fraud", F.lit(False)).alias("is_fraud"))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """One JSON payload on each line: body."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def log_lines(spark: SparkSession, *paths: str, modified_after: str | None = None) -> DataFrame:
    """source (place among paths), line_no (order of reading), value."""
    out = None
    for i, path in enumerate(paths):
        reader = spark.read.option("modifiedAfter", modified_after) if modified_after else spark.read
        part = reader.text(path).select(F.lit(i).alias("source"), F.monotonically_increasing_id().alias("line_no"), "value")
        out = part if out is None else out.union(part)
    return out


def vectors_bin(spark: SparkSession, path: str) -> DataFrame:
    """Fixed records of 16 little-endian int16: pos, q (the 14 used). The file's size must be whole records."""
    raw = spark.sparkContext.binaryRecords(path, 32).zipWithIndex().map(lambda x: (x[1], list(struct.unpack("<14h", bytes(x[0])[:28]))))
    return spark.createDataFrame(raw, "pos bigint, q array<smallint>")


def offsets_bin(spark: SparkSession, path: str) -> DataFrame:
    """Records of two little-endian uint32: cluster_id, start, end."""
    raw = spark.sparkContext.binaryRecords(path, 8).zipWithIndex().map(lambda x: (x[1], *struct.unpack("<2I", bytes(x[0]))))
    return spark.createDataFrame(raw, "cluster_id bigint, start bigint, end bigint")


def export_bin(laid: DataFrame, centers: DataFrame, offsets: DataFrame, folder: str) -> None:
    """The flat files, in order of cluster and place, streamed to a local folder by the driver one partition at a time: an export for other programs, not the engine's own store."""
    pad = [0, 0]
    order = laid.orderBy("cluster_id", "pos_in_cluster")
    with open(f"{folder}/vectors_i16.bin", "wb") as v16, open(f"{folder}/vectors_i8.bin", "wb") as v8, open(f"{folder}/labels.bin", "wb") as labels:
        for r in order.select("q", vectors.vector_i8(F.col("v")).alias("v8"), "is_fraud").toLocalIterator():
            v16.write(struct.pack("<16h", *r.q, *pad))
            v8.write(struct.pack("<16b", *r.v8, *pad))
            labels.write(bytes([int(r.is_fraud)]))
    with open(f"{folder}/centroids_i8.bin", "wb") as file:
        for r in centers.orderBy("cluster_id").toLocalIterator():
            file.write(struct.pack("<16b", *r.cv, *pad))
    with open(f"{folder}/cluster_offsets.bin", "wb") as file:
        for r in offsets.orderBy("cluster_id").toLocalIterator():
            file.write(struct.pack("<2I", r.start, r.end))
    for name, value in (("scales", 1.0), ("offsets", 0.0)):
        with open(f"{folder}/{name}.bin", "wb") as file:
            file.write(np.full(vectors.DIMS, value, "<f4").tobytes())
