import gzip
import json
import random

import numpy as np
from pyspark.sql import functions as F

from tallyvec.functions import vectors
import __spark_entry__ as spark_entry
from tallyvec.operators import ivf, knn, latency, scoring
from tallyvec.plans import inputs
from tallyvec.sources import readers


def _references(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1.0, 0.0, r.uniform(-1, 1)]) for _ in range(14)], r.random() < 0.4) for i in range(n)]
    return spark.createDataFrame(rows, "idx bigint, v array<float>, is_fraud boolean").withColumn("q", vectors.vector_i16(F.col("v")))


def test_exact_neighbours_with_ties_and_blocks(spark, monkeypatch):
    refs = _references(spark).union(_references(spark).select((F.col("idx") + 1000).alias("idx"), "v", "is_fraud", "q")).repartition(5)
    queries = refs.where("idx < 40").select(F.col("idx").alias("qid"), "q")
    monkeypatch.setattr(knn, "BLOCK", 7)
    got = {}
    for r in knn.exact(queries, refs).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.dist, r.idx))
    rows = [(r.idx, np.array(r.q, np.int64)) for r in refs.select("idx", "q").collect()]
    for qid, q in [(r.qid, np.array(r.q, np.int64)) for r in queries.collect()]:
        want = sorted((int(((q - v) ** 2).sum()), i) for i, v in rows)[:5]
        assert [(d, i) for _, d, i in sorted(got[qid])] == want


def test_no_references_and_no_queries(spark):
    refs = _references(spark, 3)
    queries = refs.select(F.col("idx").alias("qid"), "q")
    none = knn.exact(queries, refs.where("false"))
    assert [(r.fraud_score, r.approved) for r in knn.scored(queries, none).collect()] == [(0.0, True)] * 3
    assert knn.exact(queries.where("false"), refs).count() == 0
    assert not scoring.ready(None) and not scoring.ready(refs.where("false")) and scoring.ready(refs)


def test_lcg(spark):
    states, s = [], ivf.SEED
    for _ in range(5):
        s = (s * ivf.FACTOR + ivf.STEP) % 2**32
        states.append(s)
    assert states == [1967335287, 3442499178, 635173569, 1264358700, 2229145243]
    assert [r.pick for r in ivf.lcg_sample(spark, 100, 5).orderBy("draw").collect()] == [x % 100 for x in states]


def test_budget_folds(spark):
    lens = [10, 500, 500, 3, 1000] + [5000] * 11
    probed = spark.createDataFrame([(1, [0] * 14, i, 0, i + 1) for i in range(16)], "qid bigint, q array<smallint>, cluster_id int, cdist bigint, probe int")
    counts = spark.createDataFrame(list(enumerate(lens)), "cluster_id int, cnt bigint")
    got = [r.scan_len for r in ivf.with_budget(probed, counts, 3600).orderBy("probe").collect()]
    assert got[:5] == [10, 239, 239, 3, 259] and sum(got) == 3600
    even = spark.createDataFrame([(i, 11718) for i in range(16)], "cluster_id int, cnt bigint")
    assert [r.scan_len for r in ivf.with_budget(probed, even, 3600).collect()] == [225] * 16
    assert sum(r.scan_len for r in ivf.with_budget(probed, even, 5).collect()) == 5


def test_index_round_trip_and_files(spark, tmp_path):
    refs = _references(spark)
    centers = ivf.centroids(refs, 16)
    laid = ivf.layout(ivf.assign(refs, centers))
    ends = ivf.offsets(laid, 16).orderBy("cluster_id").collect()
    assert ends[0].start == 0 and ends[-1].end == 300 and all(a.end == b.start for a, b in zip(ends, ends[1:]))
    path = str(tmp_path / "index")
    ivf.write_index(spark, laid, centers, path)
    ivf.write_index(spark, laid.limit(1), centers, path)  # an existing index stays
    stored, cents = ivf.read_index(spark, path)
    assert stored.count() == 300 and cents.count() == 16
    queries = refs.where("idx < 20").select(F.col("idx").alias("qid"), "q")
    every = ivf.search(ivf.probe(queries, centers, 16), laid)
    assert ivf.recall(every, knn.exact(queries, refs)).first().recall == 1.0
    (tmp_path / "bin").mkdir()
    readers.export_bin(laid, centers, ivf.offsets(laid, 16), str(tmp_path / "bin"))
    back = readers.vectors_bin(spark, str(tmp_path / "bin/vectors_i16.bin")).orderBy("pos").collect()
    assert [r.q for r in back] == [r.q for r in laid.orderBy("cluster_id", "pos_in_cluster").collect()]
    assert [(r.start, r.end) for r in readers.offsets_bin(spark, str(tmp_path / "bin/cluster_offsets.bin")).orderBy("cluster_id").collect()] == [(r.start, r.end) for r in ends]
    assert (tmp_path / "bin/labels.bin").stat().st_size == 300 and (tmp_path / "bin/scales.bin").stat().st_size == 56


def test_two_passes_agree_with_a_plain_fold(spark):
    refs = _references(spark)
    centers = ivf.centroids(refs, 8)
    laid = ivf.layout(ivf.assign(refs, centers))
    queries = refs.where("idx < 15").select(F.col("idx").alias("qid"), "q")
    wide = ivf.two_pass(ivf.probe(queries, centers, 8), laid, ivf.sizes(laid, 8), 100_000)
    exact = knn.votes(knn.exact(queries, refs))
    assert {(r.qid, r.fraud, r.cnt) for r in wide.collect()} == {(r.qid, r.fraud, r.cnt) for r in exact.collect()}


def test_first_places_with_ties():
    r = np.random.default_rng(3)
    for n in (1, 4, 5, 6, 300):
        dist = r.integers(0, 6, (40, n)).astype(float)
        assert (knn.first_places(dist, 5) == np.argsort(dist, axis=1, kind="stable")[:, :5]).all()


def test_answers_of_the_whole_search(spark):
    """All clusters and a budget for everything: the exact votes; without references: nothing found."""
    refs = _references(spark)
    centers = ivf.centroids(refs, 8)
    laid = ivf.layout(ivf.assign(refs, centers))
    queries = refs.where("idx < 15").select(F.col("idx").alias("qid"), "q")
    exact = knn.scored(queries, knn.exact(queries, refs)).collect()
    assert sorted(ivf.answered(queries, centers, laid, probes=8, budget=100_000).collect()) == sorted(exact)
    # nothing may be scanned: all are answered exactly, and again where votes are mixed
    assert sorted(ivf.answered(queries, centers, laid, probes=8, budget=0).collect()) == sorted(exact)
    none = ivf.answered(queries, centers, laid.where("false"), probes=8).collect()
    assert len(none) == 15 and {(r.cnt, r.fraud_score, r.approved) for r in none} == {(0, 0.0, True)}


def test_registered_function_equals_batch(spark):
    refs = _references(spark)
    scoring.register(spark, refs, "score_it")
    queries = refs.where("idx < 30").select(F.col("idx").alias("qid"), "q")
    want = {r.qid: r.fraud_score for r in knn.scored(queries, knn.exact(queries, refs)).collect()}
    assert {r.qid: r.s.fraud_score for r in queries.selectExpr("qid", "score_it(q) AS s").collect()} == want
    scoring.register(spark, refs.where("false"), "score_none")
    assert queries.limit(1).selectExpr("score_none(q) AS s").first().s.err == 1


def test_references_json(spark, tmp_path):
    rows = [{"vector": [0.1] * 20, "label": "fraud", "extra": 1}, {"vector": [1], "label": "legit"}, {"vector": [], "label": None}]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows, f)
    got = readers.references_json(spark, str(tmp_path / "r.json.gz")).orderBy("idx").collect()
    assert [r.is_fraud for r in got] == [True, False, False] and all(len(r.v) == 14 for r in got)


def test_logs(spark, tmp_path):
    (tmp_path / "lb.log").write_text("x req_id=a fe st=200 Tq=1 Tw=2 Tc=0 Tr=4 Tt=9\nnoise\nx req_id=a fe st=503 Tq=-1 Tw=-1 Tc=-1 Tr=-1 Tt=30\nx req_id=b fe st=200 Tq=0 Tw=0 Tc=0 Tr=1 Tt=2\n")
    (tmp_path / "s1.log").write_text('p {"kind":"req_trace","req_id":"a","t_total_us":1000}\np {"kind":"req_trace","req_id":"c"}\np {"kind":"req_trace" broken\n{"kind":"req_trace","req_id":""}\n')
    (tmp_path / "s2.log").write_text('{"kind":"req_trace","req_id":"a","t_total_us":2000,"t_eval_us":500}\n')
    access = latency.parse_access(readers.log_lines(spark, str(tmp_path / "lb.log")))
    trace = latency.parse_trace(readers.log_lines(spark, str(tmp_path / "s1.log"), str(tmp_path / "s2.log")))
    facts = latency.joined(access, trace, "ms")
    rows = facts.collect()
    assert [(r.req_id, r.status, r.lb_qw_ms, r.lb_tt_ms, r.go_total_ms, r.go_eval_ms, r.go_read_ms, r.non_go_overhead_ms) for r in rows] == [("a", 503, -1.0, 30.0, 2.0, 0.5, 0.0, 28.0)]
    assert latency.joined(access, trace).first().lb_tt_ms == 0.03
    latency.write_report(facts, str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[:3] == ["# E2E Latency Report", "- Input dir: `logs`", "- Joined requests: `1`"] and len(lines) == 27
    assert "| `a` | 503 | 30.000 | -1.000 | -1.000 | 2.000 | 0.500 | 28.000 |" in lines
    assert lines[-4:] == ["- Dominant bottleneck candidate: `zig_eval`", "- p99 lb_qw_ms: `-1.000`", "- p99 go_eval_ms: `0.500`", "- p99 go_parse_ms: `0.000`"]


def test_percentiles_of_few_and_none(spark):
    zero = [f"0.0D AS {m}" for m in latency.METRICS if m != "lb_tt_ms"]
    facts = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "lb_tt_ms double").selectExpr("lb_tt_ms", *zero)
    got = {r.metric: (r.p50, round(r.p95, 9), round(r.p99, 9)) for r in latency.percentiles(facts).collect()}
    assert got["lb_tt_ms"] == (3.0, 8.8, 9.76)
    assert {(r.p50, r.p99) for r in latency.percentiles(facts.where("false")).collect()} == {(0.0, 0.0)}


def test_scores_beyond_what_is_carried(spark, monkeypatch):
    for name in ("udf_score_eval", "stream_score"):
        run = lambda: spark_entry.queries()[name](spark, spark_entry.SMOKE_DIR)  # noqa: B023, E731
        want = run()
        rows = sorted(want.collect())
        monkeypatch.setattr(scoring, "MOST_CARRIED", 10)
        got = run()
        assert got.dtypes == want.dtypes and sorted(got.collect()) == rows and rows
        monkeypatch.undo()


def test_positions_of_many_shuffled_rows(spark):
    """Positions are those of a plain sort, however the ranges fall."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 3_000_000, 3, 16).select(F.col("id").alias("idx")).repartition(16, F.xxhash64("idx"))
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert ivf.numbered(rows).where("pos * 3 <> idx").count() == 0
        assert ivf.numbered(rows).count() == 1_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trace_lines_end_with_their_object(spark):
    good = '{"kind":"req_trace","req_id":"a","t_total_us":5}'
    rows = [("s", 0, "x " + good), ("s", 1, good.replace('"a"', '"b"') + " trailing"), ("s", 2, good.replace('"a"', '"c"') + "}"), ("s", 3, good.replace('"a"', '"d"') + "  "), ("s", 4, good.replace('"a"', '"e"')[:-1])]
    lines = spark.createDataFrame(rows, "source string, line_no bigint, value string")
    assert sorted(r.req_id for r in latency.parse_trace(lines).collect()) == ["a", "d"]


def test_trees_compare_few_and_lose_none(monkeypatch):
    """Neighbours by brute force, with ties, copies and small limits; of far apart boxes only a few distances are computed."""
    rng = np.random.default_rng(3)
    for n, dims, span, leaf, pairs, cells in ((0, 14, 5, 256, 10**6, 10**6), (3, 14, 5, 4, 10, 100), (3000, 14, 2, 4, 50, 100), (3000, 4, 3, 8, 1000, 5000), (3000, 14, 32767, 16, 1000, 5000), (2000, 2, 1, 8, 9, 30)):
        for name, value in (("LEAF", leaf), ("PAIRS", pairs), ("CELLS", cells)):
            monkeypatch.setattr(knn, name, value)
        x, idx, fraud = rng.integers(-span, span + 1, (n, dims)).astype(float), rng.permutation(2 * n)[:n], rng.random(n) < 0.3
        q = rng.integers(-span, span + 1, (40, dims)).astype(float)
        best = knn.nothing(len(q), 5)
        for s in np.array_split(np.arange(n), 3):
            best = knn.Tree(x[s], idx[s], fraud[s], 5).search(q, best)
        dist = ((q[:, None] - x[None]) ** 2).sum(2)
        for i in range(len(q)):
            want = np.lexsort((idx, dist[i]))[:5]
            there = np.isfinite(best[0][i])
            assert [c[i][there].tolist() for c in best] == [dist[i][want].tolist(), idx[want].tolist(), fraud[want].tolist()]
    monkeypatch.undo()
    seen, plain = [], knn.Tree._distances
    monkeypatch.setattr(knn.Tree, "_distances", lambda self, q, start, end: (seen.append(len(q) * (end - start)), plain(self, q, start, end))[1])
    x = rng.integers(0, 60, (50_000, 14)) + 3000 * rng.integers(0, 8, (50_000, 1))
    knn.Tree(x.astype(float), np.arange(len(x)), np.zeros(len(x), bool), 5).search(x[::100].astype(float)[:, ::1], knn.nothing(500, 5))
    assert sum(seen) < 500 * 50_000 / 3


def _computed(spark, monkeypatch, name):
    """How many references a query computes the features of, if its queries take three blocks."""
    count, plain = spark.sparkContext.accumulator(0), inputs.event_vectors

    def passed(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    def spied(*args):
        rows = plain(*args)
        return rows.mapInArrow(passed, rows.schema)

    monkeypatch.setattr(inputs, "event_vectors", spied)
    monkeypatch.setattr(scoring, "MOST_CARRIED", 10)
    monkeypatch.setattr(knn, "BLOCK", 4)
    assert spark_entry.queries()[name](spark, spark_entry.SMOKE_DIR).count() == 10
    return count.value


def test_stream_score_computes_references_once(spark, monkeypatch):
    assert _computed(spark, monkeypatch, "stream_score") == 1000


def test_transaction_fraud_score_computes_references_once(spark, monkeypatch):
    assert _computed(spark, monkeypatch, "transaction_fraud_score") == 1000


def test_features_are_dealt_over_all_cores(spark):
    """The table is one file of one row group."""
    assert inputs.event_vectors(spark, spark_entry.SMOKE_DIR).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_function_with_copies_and_few_references(spark):
    refs = _references(spark, 40)
    many = refs.union(refs.select((F.col("idx") + 1000).alias("idx"), "v", ~F.col("is_fraud"), "q")).union(refs.select((F.col("idx") + 2000).alias("idx"), "v", "is_fraud", "q"))
    queries = refs.select(F.col("idx").alias("qid"), "q")
    for name, some in (("score_copies", many), ("score_few", refs.where("idx < 3"))):
        scoring.register(spark, some, name)
        want = {(r.qid, r.fraud_score, r.err) for r in scoring.evaluated(queries, some).collect()}
        assert {(r.qid, r.s.fraud_score, r.s.err) for r in queries.selectExpr("qid", f"{name}(q) AS s").collect()} == want
