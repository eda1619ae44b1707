"""Queries by name; oracles.py has the same results as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features, transport, vectors
from ..operators import ivf, knn, latency, scoring
from ..sources import shared
from ..streaming import jobs
from . import inputs, oracles

#: For the small tables here; the operators' own defaults are those of the full-size index.
CLUSTERS, PROBES, SMALL_BUDGET = 16, 8, 100


def quantize_i16(spark, d):
    return inputs.labelled(spark, d).select("idx", vectors.joined(F.col("q")).alias("q"))


def quantize_i8(spark, d):
    return inputs.labelled(spark, d).select("idx", vectors.joined(vectors.vector_i8(F.col("v"))).alias("q8"))


def requantize_i8(spark, d):
    return inputs.labelled(spark, d).select("idx", vectors.joined(vectors.vector_i16_to_i8(F.col("q"))).alias("q8"))


def sq_l2_distance(spark, d):
    rows = inputs.labelled(spark, d).select("idx", "q")
    nxt = rows.select((F.col("idx") - 1).alias("idx"), F.col("q").alias("r"))
    return rows.join(nxt, "idx").select("idx", vectors.squared_distance(F.col("q"), F.col("r")).alias("dist"))


def _exact(spark, d):
    return knn.exact(inputs.vector_queries(spark, d), inputs.labelled(spark, d))


def exact_knn_top5(spark, d):
    return _exact(spark, d).select("qid", "rank", "idx", "dist")


def _scored(spark, d):
    return knn.scored(inputs.vector_queries(spark, d), _exact(spark, d))


def knn_votes(spark, d):
    return _scored(spark, d).select("qid", "fraud", "cnt")


def knn_fraud_score(spark, d):
    return _scored(spark, d).select("qid", "fraud_score", "approved")


def knn_decision_json(spark, d):
    return _scored(spark, d).select("qid", transport.response(F.col("approved"), F.col("fraud_score")).alias("response"))


def payload_parse(spark, d):
    real = [c for c, t in inputs.featured(spark, d).dtypes if t == "float"]
    rows = inputs.featured(spark, d)
    return rows.select("qid", *(F.col(c).cast("double").alias(c) if c in real else F.col(c) for c in rows.columns if c not in ("qid", "event_type")))


def payload_defaults(spark, d):
    empty = inputs.events(spark, d).select(F.col("event_id").alias("qid"), F.when(F.col("k") % 2 == 0, "{}").otherwise('{"transaction":{"amount":1.5},"merchant":{"id":"m"}}').alias("body"))
    rows = features.with_features(features.parse(empty))
    return rows.select("qid", F.col("transaction_amount").cast("double").alias("amount"), "merchant_unknown", F.round(F.col("mcc_risk").cast("double"), 6).alias("mcc_risk"), "terminal_is_online", "has_last_transaction", "transaction_hour", "last_transaction_minutes")


def ts_hour_dow(spark, d):
    iso = inputs.iso(F.col("ts"))
    return inputs.events(spark, d).select("event_id", features.hour_of(iso).alias("hour"), features.day_of_week(iso).alias("dow"), features.minutes_of(iso).alias("minutes"))


def minutes_since_last(spark, d):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = inputs.events(spark, d).withColumn("before", before)
    return rows.select("event_id", features.minutes_between(inputs.iso(F.col("ts")), inputs.iso(F.col("before"))).alias("minutes"))


def fnv1a_hash(spark, d):
    return inputs.events(spark, d).select("event_id", features.fnv1a(F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"))).alias("hash"))


def merchant_unknown(spark, d):
    known = F.concat(F.transform(F.sequence(F.lit(1), F.col("k") % 40 + 1), lambda i: F.concat(F.lit("m"), i.cast("string"))), F.array(F.col("event_type")))
    return inputs.events(spark, d).select("event_id", features.merchant_unknown(known, F.col("event_type")).alias("unknown"))


def mcc_risk_lookup(spark, d):
    code = F.element_at(F.create_map(*(F.lit(x) for p in inputs.MCC.items() for x in p)), F.col("event_type"))
    number = features.mcc_number(F.when(F.col("k") % 3 == 0, F.lit("none")).otherwise(code))
    return inputs.events(spark, d).select("event_id", number.alias("mcc"), F.round(features.mcc_risk(number).cast("double"), 6).alias("risk"))


def feature_vector(spark, d):
    rows = inputs.featured(spark, d)
    return rows.select("qid", F.posexplode(features.normalized()).alias("dim", "x")).select("qid", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


def feature_vector_q16(spark, d):
    rows = inputs.featured(spark, d)
    return rows.select("qid", vectors.joined(features.vector_of(rows)).alias("q"))


def transaction_fraud_score(spark, d):
    refs = shared.written(inputs.event_vectors(spark, d), "references")
    requests = inputs.transactions(spark, d).where("qid % 100 = 0")
    return scoring.score_requests(requests, refs).select("qid", "fraud", "fraud_score", "approved", "response")


def udf_score_eval(spark, d):
    refs = shared.written(inputs.event_vectors(spark, d), "references")
    queries = refs.where("idx % 100 = 0").select(F.col("idx").alias("qid"), "q")
    if not scoring.carried(refs):
        return scoring.evaluated(queries, refs)
    scoring.register(spark, refs)
    return queries.select("qid", F.expr("score_eval(q)").alias("s")).select("qid", "s.fraud_score", F.col("s.err").alias("err"))


def lcg_sample(spark, d):
    return ivf.lcg_sample(spark, inputs.labelled(spark, d).count())


def _centers(spark, d):
    return ivf.centroids(inputs.labelled(spark, d), CLUSTERS)


def _index(spark, d):
    centers = _centers(spark, d)
    return centers, ivf.layout(ivf.assign(inputs.labelled(spark, d), centers))


def centroids(spark, d):
    return _centers(spark, d).select("cluster_id", vectors.joined(F.col("cv")).alias("cv"))


def cluster_assign(spark, d):
    return _index(spark, d)[1].select("idx", "cluster_id")


def cluster_sizes(spark, d):
    return ivf.sizes(_index(spark, d)[1], CLUSTERS)


def cluster_offsets(spark, d):
    return ivf.offsets(_index(spark, d)[1], CLUSTERS)


def cluster_layout(spark, d):
    laid = _index(spark, d)[1]
    starts = ivf.offsets(laid, CLUSTERS)
    return laid.join(F.broadcast(starts), "cluster_id").select("idx", "cluster_id", "pos_in_cluster", (F.col("start") + F.col("pos_in_cluster")).alias("pos"))


def _probed(spark, d):
    centers, laid = _index(spark, d)
    return ivf.probe(inputs.vector_queries(spark, d), centers, PROBES), laid


def ivf_probe(spark, d):
    return _probed(spark, d)[0].select("qid", "probe", "cluster_id", "cdist")


def ivf_budget(spark, d):
    probed, laid = _probed(spark, d)
    return ivf.with_budget(probed, ivf.sizes(laid, CLUSTERS), SMALL_BUDGET).select("qid", "probe", "cluster_id", "scan_len")


def ivf_budgeted_knn(spark, d):
    probed, laid = _probed(spark, d)
    return ivf.budgeted(probed, laid, ivf.sizes(laid, CLUSTERS), SMALL_BUDGET).select("qid", "rank", "idx", "dist")


def ivf_knn(spark, d):
    return ivf.search(*_probed(spark, d)).select("qid", "rank", "idx", "dist")


def ivf_score(spark, d):
    """The first pass over the budget, refined where votes are mixed."""
    probed, laid = _probed(spark, d)
    first = ivf.budgeted(probed, laid, ivf.sizes(laid, CLUSTERS), SMALL_BUDGET)
    return knn.scored(inputs.vector_queries(spark, d), ivf.refined(first, probed, laid)).select("qid", "fraud", "fraud_score", "approved")


def ivf_fallback(spark, d):
    """One probe within a budget of 3 vectors can't fill five places: all queries are answered exactly."""
    centers, laid = _index(spark, d)
    queries = inputs.vector_queries(spark, d)
    few = ivf.budgeted(ivf.probe(queries, centers, 1), laid, ivf.sizes(laid, CLUSTERS), 3)
    return ivf.with_fallback(queries, few, inputs.labelled(spark, d)).select("qid", "rank", "idx", "dist")


def ivf_recall(spark, d):
    return ivf.recall(ivf.search(*_probed(spark, d)), _exact(spark, d))


def ivf_two_pass_compat(spark, d):
    probed, laid = _probed(spark, d)
    return ivf.two_pass(probed, laid, ivf.sizes(laid, CLUSTERS), SMALL_BUDGET)


def ivf_orchestrated(spark, d):
    """The whole search: both passes, exact neighbours where too few, votes, refined where they are mixed."""
    centers, laid = _index(spark, d)
    laid = shared.written(laid, "index")
    return ivf.answered(inputs.vector_queries(spark, d), centers, laid, probes=PROBES, budget=SMALL_BUDGET)


def ivf_orchestrated_sparse(spark, d):
    """The same within one probe and a budget of 6 vectors, so that many queries find too few."""
    centers, laid = _index(spark, d)
    laid = shared.written(laid, "index")
    return ivf.answered(inputs.vector_queries(spark, d), centers, laid, probes=1, budget=6)


def scan_stats(spark, d):
    probed, laid = _probed(spark, d)
    return ivf.scan_stats(ivf.with_budget(probed, ivf.sizes(laid, CLUSTERS), SMALL_BUDGET))


def request_status(spark, d):
    c = F.col
    return inputs.http_requests(spark, d).select("event_id", transport.status(c("method"), c("path"), c("header_ends"), c("length"), c("body")).alias("status"))


def round_robin_backend(spark, d):
    return inputs.events(spark, d).select("event_id", transport.backend(F.col("event_id")).alias("backend"))


def bitpack_roundtrip(spark, d):
    tag = transport.pack_tag(F.col("k") % 8, F.col("event_id") * 2654435, F.col("user_id"))
    op, generation, conn = transport.unpack_tag(F.col("tag"))
    return inputs.events(spark, d).select("event_id", tag.alias("tag")).select("event_id", "tag", op.alias("op"), generation.alias("generation"), conn.alias("conn"))


def lb_log_parse(spark, d):
    return latency.parse_access(inputs.access_lines(spark, d))


def trace_parse(spark, d):
    return latency.parse_trace(inputs.trace_lines(spark, d).where("source = 0")).drop("source")


def trace_union_last_wins(spark, d):
    return latency.parse_trace(inputs.trace_lines(spark, d))


def _facts(spark, d):
    return latency.joined(lb_log_parse(spark, d), trace_union_last_wins(spark, d), "ms")


def latency_join(spark, d):
    return _facts(spark, d)


def latency_percentiles(spark, d):
    return latency.percentiles(_facts(spark, d)).select("metric", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


def latency_top5(spark, d):
    return latency.slowest(_facts(spark, d)).select("req_id", "lb_tt_ms", "go_total_ms", "status")


def latency_bottleneck(spark, d):
    return latency.bottleneck(latency.percentiles(_facts(spark, d))).select("bottleneck", *(F.round(c, 6).alias(c) for c in ("p99_queue", "p99_eval", "p99_parse")))


def latency_report_md(spark, d):
    return latency.report_lines(shared.written(_facts(spark, d), "facts"), "events")


def rolling_features(spark, d):
    """Of each event: how many the user had in the 24 hours before, and their sum in cents."""
    e = inputs.events(spark, d).withColumn("us", F.unix_micros("ts"))
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, -1)
    return e.select("event_id", F.count("*").over(day).alias("tx_count_24h"), F.coalesce(F.sum(F.round(F.col("value") * 100).cast("bigint")).over(day), F.lit(0)).alias("cents_24h"))


def _stream_paths(spark):
    import uuid

    path = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{path}/out", f"{path}/state"


def stream_score(spark, d):
    """Requests as a stream: the same scores as in batch."""
    refs = shared.written(inputs.event_vectors(spark, d), "references")
    stream = jobs.read_events(spark, d).where("event_id % 100 = 0")

    def vector(requests):
        rows = features.with_features(features.parse(requests))
        return rows.select("qid", features.vector_of(rows).alias("q"))

    out, state = _stream_paths(spark)
    requests = inputs.transactions_of(stream).select("qid", "body")
    if scoring.carried(refs):
        jobs.run_available(jobs.score_stream(requests, vector, scoring.score_function(refs)), out, state)
    else:
        jobs.score_batches(requests, out, state, vector, lambda queries: scoring.evaluated(queries, refs))
    return spark.read.schema("qid bigint, fraud_score double, approved boolean").parquet(out).select("qid", "fraud_score", "approved")


def stream_rolling_features(spark, d):
    stream = jobs.read_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out, state = _stream_paths(spark)
    jobs.run_available(jobs.hourly_counts(stream), out, state, "complete")
    return spark.read.parquet(out).select("user_id", F.unix_seconds("hour").alias("hour"), "n", "cents")


_ALL = (
    quantize_i16, quantize_i8, requantize_i8, sq_l2_distance, exact_knn_top5, knn_votes, knn_fraud_score, knn_decision_json, payload_parse, payload_defaults,
    ts_hour_dow, minutes_since_last, fnv1a_hash, merchant_unknown, mcc_risk_lookup, feature_vector, feature_vector_q16, transaction_fraud_score, udf_score_eval,
    lcg_sample, centroids, cluster_assign, cluster_sizes, cluster_offsets, cluster_layout, ivf_probe, ivf_budget, ivf_budgeted_knn, ivf_knn, ivf_score, ivf_fallback,
    ivf_recall, ivf_two_pass_compat, ivf_orchestrated, ivf_orchestrated_sparse, scan_stats, request_status, round_robin_backend, bitpack_roundtrip, lb_log_parse, trace_parse, trace_union_last_wins,
    latency_join, latency_percentiles, latency_top5, latency_bottleneck, latency_report_md, rolling_features, stream_score, stream_rolling_features,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = oracles.ORACLE_SQL
