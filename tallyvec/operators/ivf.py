"""Inverted-file index: build, probe, budgeted and exact search within the probed clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources import shared
from . import knn

CLUSTERS, PROBES, DRAWS = 256, 16, 50_000
BUDGET, FIRST_SHARE = 6000, (3, 5)
#: Draws are made by this linear congruential rule, modulo 2 ** 32.
SEED, FACTOR, STEP = 0x12345678, 1664525, 1013904223


def lcg_sample(spark, n: int, draws: int = DRAWS) -> DataFrame:
    """draw, pick: min(n, draws) row numbers below n, with replacement; their number is bounded."""
    state, picks = SEED, []
    for _ in range(min(n, draws)):
        state = (state * FACTOR + STEP) % (1 << 32)
        picks.append(state % n)
    frame = pd.DataFrame({"draw": np.arange(len(picks), dtype=np.int64), "pick": np.array(picks, np.int64)})
    return spark.createDataFrame(frame, "draw bigint, pick bigint")


def numbered(references: DataFrame) -> DataFrame:
    """references with pos, their place by idx from 0: places within sorted ranges, and the ranges' sizes before them.

    The ranged rows are written once: another run of a range exchange may sample other bounds.
    """
    ranged = shared.written(references.repartitionByRange("idx").sortWithinPartitions("idx").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def centroids(references: DataFrame, clusters: int = CLUSTERS, draws: int = DRAWS) -> DataFrame:
    """cluster_id, cv: int8 means of the drawn vectors, draw i going to cluster i mod clusters; clusters without draws are 0.

    references: (idx, v). Whole numbers are summed and divided once.
    """
    spark = references.sparkSession
    rows = numbered(references.select("idx", vectors.vector_i8(F.col("v")).alias("v8")))
    sample = lcg_sample(spark, references.count(), draws)
    cells = rows.join(F.broadcast(sample), F.col("pos") == F.col("pick")).select(F.pmod("draw", F.lit(clusters)).cast("int").alias("cluster_id"), F.posexplode("v8").alias("dim", "x"))
    means = cells.groupBy("cluster_id", "dim").agg(F.round(F.sum(F.col("x").cast("bigint")) / F.count("*")).cast("int").alias("m"))
    packed = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"].cast("tinyint")).alias("cv"))
    every = spark.range(clusters).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(packed, "cluster_id", "left").select("cluster_id", F.coalesce("cv", F.array_repeat(F.lit(0).cast("tinyint"), vectors.DIMS)).alias("cv"))


def assign(references: DataFrame, centers: DataFrame) -> DataFrame:
    """references with cluster_id, the nearest centroid (ties: the lowest); centroids, a bounded number, are broadcast and nothing is shuffled."""
    rows = sorted((r.cluster_id, r.cv) for r in centers.collect())
    table = np.array([c for _, c in rows], np.float64)
    held = references.sparkSession.sparkContext.broadcast((np.array([i for i, _ in rows], np.int32), table, (table * table).sum(1)))
    cols = references.columns

    def run(batches):
        ids, c, norm = held.value
        for batch in batches:
            x = batch.column(len(cols)).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, c.shape[1])
            nearest = ids[(norm[None, :] - 2 * x @ c.T).argmin(1)] if batch.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(nearest, pa.int32())], names=[*cols, "cluster_id"])

    schema = references.withColumn("cluster_id", F.lit(0)).schema
    return references.withColumn("_v8", vectors.vector_i8(F.col("v")).cast("array<int>")).mapInArrow(run, schema)


def sizes(assigned: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    every = assigned.sparkSession.range(clusters).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(assigned.groupBy("cluster_id").agg(F.count("*").alias("cnt")), "cluster_id", "left").na.fill(0, ["cnt"])


def offsets(assigned: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    """cluster_id, start, end: exclusive prefix sums over the bounded list of clusters."""
    before = F.sum("cnt").over(Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1))
    return sizes(assigned, clusters).select("cluster_id", F.coalesce(before, F.lit(0)).alias("start"), "cnt").select("cluster_id", "start", (F.col("start") + F.col("cnt")).alias("end"))


def layout(assigned: DataFrame) -> DataFrame:
    """assigned with pos_in_cluster, by idx from 0."""
    return assigned.withColumn("pos_in_cluster", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("idx")) - 1).cast("bigint"))


def write_index(spark, laid: DataFrame, centers: DataFrame, path: str, overwrite: bool = False) -> None:
    """The index as tables, clustered by cluster_id; an existing one stays unless it is to be overwritten."""
    mode = "overwrite" if overwrite else "ignore"
    laid.repartition("cluster_id").sortWithinPartitions("cluster_id", "pos_in_cluster").write.mode(mode).partitionBy("cluster_id").parquet(f"{path}/vectors")
    centers.write.mode(mode).parquet(f"{path}/centroids")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids")


def probe(queries: DataFrame, centers: DataFrame, probes: int = PROBES) -> DataFrame:
    """qid, q, cluster_id, cdist, probe (from 1): the nearest clusters of each query; there is a bounded number of clusters."""
    q8 = queries.withColumn("_q8", vectors.vector_i16_to_i8(F.col("q")))
    pairs = q8.crossJoin(F.broadcast(centers)).select("qid", "q", "cluster_id", vectors.squared_distance(F.col("_q8"), F.col("cv")).alias("cdist"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("cdist", "cluster_id"))
    return pairs.withColumn("probe", rank).where(F.col("probe") <= probes)


def members(probed: DataFrame, laid: DataFrame) -> DataFrame:
    """Every vector of every probed cluster with its distance. An equi-join on cluster_id; large clusters are split by the adaptive skew join."""
    both = probed.join(laid.select("cluster_id", "idx", F.col("q").alias("_r"), "is_fraud", "pos_in_cluster"), "cluster_id")
    return both.select("qid", "cluster_id", "probe", "pos_in_cluster", "idx", "is_fraud", vectors.squared_distance(F.col("q"), F.col("_r")).alias("dist"))


def search(probed: DataFrame, laid: DataFrame, k: int = knn.K) -> DataFrame:
    """The exact k nearest within the probed clusters."""
    return knn.top(members(probed, laid).select("qid", "idx", "dist", "is_fraud"), k)


def with_budget(probed: DataFrame, counts: DataFrame, budget: int) -> DataFrame:
    """probed with scan_len: each probe's share of what budget is left, at least 1, no more than its cluster; one fold over each query's few probes."""
    rows = probed.join(F.broadcast(counts.select("cluster_id", "cnt")), "cluster_id")
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("probe", "cluster_id", F.col("cnt").cast("bigint").alias("cnt")))).alias("p"))
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<struct<probe:int,cluster_id:int,scan_len:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ahead = F.size("p") - F.size(acc["out"])
        share = F.when(acc["left"] <= 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.floor(acc["left"] / ahead), F.lit(1).cast("bigint")))
        taken = F.least(share, x["cnt"], F.greatest(acc["left"], F.lit(0).cast("bigint")))
        return F.struct((acc["left"] - taken).alias("left"), F.concat(acc["out"], F.array(F.struct(x["probe"].alias("probe"), x["cluster_id"].alias("cluster_id"), taken.alias("scan_len")))).alias("out"))

    folded = lists.select("qid", F.explode(F.aggregate("p", start, step, lambda a: a["out"])).alias("o")).select("qid", "o.*")
    return probed.join(folded, ["qid", "cluster_id", "probe"])


def budgeted(probed: DataFrame, laid: DataFrame, counts: DataFrame, budget: int, k: int = knn.K) -> DataFrame:
    """The k nearest among the prefixes of the probed clusters that the budget allows."""
    lens = with_budget(probed, counts, budget)
    rows = members(probed, laid).join(lens.select("qid", "cluster_id", "scan_len"), ["qid", "cluster_id"]).where("pos_in_cluster < scan_len")
    return knn.top(rows.select("qid", "idx", "dist", "is_fraud"), k)


def with_fallback(queries: DataFrame, found: DataFrame, references: DataFrame, k: int = knn.K) -> DataFrame:
    """found, and for queries with fewer than k neighbours the exact ones instead."""
    few = queries.join(found.groupBy("qid").agg(F.count("*").alias("_n")), "qid", "left").where(F.coalesce("_n", F.lit(0)) < k).select("qid", "q")
    kept = found.join(few.select("qid"), "qid", "left_anti").select("qid", "idx", "dist", "is_fraud", "rank")
    return kept.union(knn.exact(few, references, k).select(*kept.columns))


def refined(first: DataFrame, probed: DataFrame, laid: DataFrame, k: int = knn.K) -> DataFrame:
    """first, but the exact neighbours within the probed clusters for queries whose votes are mixed."""
    v = knn.votes(first)
    mixed = v.where((F.col("cnt") == k) & (F.col("fraud") > 0) & (F.col("fraud") < k)).select("qid")
    again = search(probed.join(mixed, "qid", "left_semi"), laid, k)
    kept = first.join(mixed, "qid", "left_anti").select("qid", "idx", "dist", "is_fraud", "rank")
    return kept.union(again.select(*kept.columns))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries' exact neighbours, how many of them were found, and their share."""
    both = exact.select("qid", "idx").join(found.select("qid", "idx", F.lit(1).alias("_hit")), ["qid", "idx"], "left")
    return both.agg(F.count("*").alias("expected"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.col("expected"))


def two_pass_neighbours(probed: DataFrame, laid: DataFrame, counts: DataFrame, budget: int = BUDGET, k: int = knn.K) -> DataFrame:
    """qid, idx, dist, is_fraud, rank after both passes, in scan order; equal distances rank by the order of the scan.

    The second pass extends the two probes most of whose vectors ever entered the running top k (of equal ones the later
    probe), each by its share of the budget, at least one vector, from its cluster's start; if only one probe gave any,
    the nearest probe is the other. Order matters, so queries are folded one by one, over no more candidates than the
    budget allows for either pass. Queries whose probed clusters are all empty have no rows.
    """
    first = budget * FIRST_SHARE[0] // FIRST_SHARE[1]
    second = budget - first
    lens = with_budget(probed, counts, first)
    longest = F.greatest("scan_len", F.lit(max(second, 1)))
    rows = members(probed, laid).join(lens.select("qid", "cluster_id", "scan_len"), ["qid", "cluster_id"]).where(F.col("pos_in_cluster") < longest)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["probe", "pos_in_cluster"])
        best: list[tuple[int, int, bool]] = []
        gave: dict[int, int] = {}

        def offer(dist: int, idx: int, fraud: bool) -> bool:
            if len(best) == k and dist >= best[-1][0] or any(i == idx for _, i, _ in best):
                return False
            at = next((n for n, (d, _, _) in enumerate(best) if d > dist), len(best))
            best.insert(at, (dist, idx, fraud))
            del best[k:]
            return True

        for r in g[g.pos_in_cluster < g.scan_len].itertuples():
            gave[r.probe] = gave.get(r.probe, 0) + offer(r.dist, r.idx, r.is_fraud)
        chosen = [p for p in sorted(gave, key=lambda p: (-gave[p], -p))[:2] if gave[p]]
        total = sum(gave[p] for p in chosen)
        for p in (chosen + [1])[:2] if chosen else ():
            share = max(second * gave.get(p, 0) // total if p in chosen else 0, 1)
            for r in g[(g.probe == p) & (g.pos_in_cluster < share)].itertuples():
                offer(r.dist, r.idx, r.is_fraud)
        return pd.DataFrame({"qid": int(g.qid.iloc[0]), "idx": [i for _, i, _ in best], "dist": [d for d, _, _ in best], "is_fraud": [f for _, _, f in best], "rank": range(1, len(best) + 1)})

    return rows.groupBy("qid").applyInPandas(fold, "qid bigint, idx bigint, dist bigint, is_fraud boolean, rank int")


def two_pass(probed: DataFrame, laid: DataFrame, counts: DataFrame, budget: int = BUDGET, k: int = knn.K) -> DataFrame:
    """qid, fraud, cnt, fraud_score after both passes."""
    found = knn.votes(two_pass_neighbours(probed, laid, counts, budget, k))
    return found.select("qid", "fraud", "cnt", knn.score(F.col("fraud"), F.col("cnt")).alias("fraud_score"))


def answered(queries: DataFrame, centers: DataFrame, laid: DataFrame, *, probes: int = PROBES, budget: int = BUDGET, k: int = knn.K) -> DataFrame:
    """qid, fraud, cnt, fraud_score, approved of every query by the whole search: probes, both passes within the budget, the
    exact neighbours where fewer than k were found, votes, and all of the probed clusters where the votes are mixed.

    Probes and what each step found are written once, because the next steps read them more than once. Without any
    references every query has score 0 and is approved.
    """
    clusters = centers.count()
    probed = shared.written(probe(queries, centers, probes), "probed")
    first = shared.written(two_pass_neighbours(probed, laid, sizes(laid, clusters), budget, k), "passes")
    found = shared.written(with_fallback(queries, first, laid.select("idx", "q", "is_fraud"), k), "found")
    return knn.scored(queries, refined(found, probed, laid, k))


def scan_stats(lens: DataFrame) -> DataFrame:
    """Requests, probes, and vectors scanned, exactly."""
    return lens.agg(F.countDistinct("qid").alias("requests"), F.count("*").alias("probes"), F.sum("scan_len").alias("scanned"))
