"""Shared helpers: settings, the shared folder, reading tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: bounds a Python worker's memory.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyvec-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table written to the shared folder and read again: its lineage ends there, and lost executors take nothing with them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let the driver's JVM notice plans that are done with, so that the shuffle files behind them are deleted."""
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % F.lit(parts)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label (the smallest node of its connected component) for every node of edges (a, b).

    Minimum labels spread over the edges and are then followed to their own labels, so that paths halve; every round is
    a written table. A hub's rows are combined before they are shuffled.
    """
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")), f"{name}-edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        after = written(least.join(jump, "least").select("node", F.least("least", "far").alias("label"), (F.least("least", "far") < F.col("label")).alias("moved")), name)
        moved = after.where("moved").limit(1).count()
        dropped(labels)
        labels = after.select("node", "label")
        if not moved:
            dropped(both)
            return labels


def bit_table(df: DataFrame, digest: str, bits: int):
    """A bit array of fixed size (as 64-bit words) with the bits of these digests set: says for sure which aren't among them."""
    import numpy as np

    bit = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))
    words = df.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.view(np.uint64)


def in_bits(table, digest: bytes, bits: int) -> bool:
    bit = int.from_bytes(digest[:4], "big") & ((1 << bits) - 1)
    return bool(int(table[bit >> 6]) >> (bit & 63) & 1)
