"""The queries of the catalogue as DuckDB SQL."""

from __future__ import annotations


def _q(x: str, scale: int, least: int, most: int) -> str:
    return f"greatest({least}, least({most}, CAST(round(CAST(CAST({x} AS FLOAT) * CAST({scale} AS FLOAT) AS DOUBLE)) AS INTEGER)))"


_Q16, _Q8 = _q("x", 32767, -32768, 32767), _q("x", 127, -128, 127)
_V = f"""v AS (SELECT vec_id AS idx, embedding[1:14] AS v, label < 3 AS is_fraud, [{_Q16} FOR x IN embedding[1:14]] AS q, [{_Q8} FOR x IN embedding[1:14]] AS v8 FROM embeddings),
refs AS (SELECT * FROM v), qs AS (SELECT idx AS qid, q, [greatest(-128, least(127, x // 258)) FOR x IN q] AS q8 FROM v WHERE idx % 100 = 0)"""


def _dist(a: str, b: str, n: int = 14) -> str:
    return "(" + " + ".join(f"({a}[{i}]::BIGINT - {b}[{i}]::BIGINT) * ({a}[{i}]::BIGINT - {b}[{i}]::BIGINT)" for i in range(1, n + 1)) + ")"


def _top(source: str) -> str:
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, idx) AS INTEGER) AS rank FROM {source} QUALIFY rank <= 5)"


_EXACT = f"{_V}, pairs AS (SELECT qid, idx, is_fraud, {_dist('qs.q', 'refs.q')} AS dist FROM qs, refs), nn AS {_top('pairs')}"
_SCORED = "sc AS (SELECT qid, CAST(sum(CAST(is_fraud AS INTEGER)) AS BIGINT) AS fraud, count(*) AS cnt FROM nn GROUP BY qid)"
_RESPONSE = """'{"approved":' || CASE WHEN fraud * 5 < cnt * 3 THEN 'true' ELSE 'false' END || ',"fraud_score":' || printf('%.6f', fraud / cnt) || '}'"""

# transactions out of events
_E = "e AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"
_ISO_MIN = "datediff('minute', TIMESTAMP '1970-01-01', {})"
_RISK = "CASE {} WHEN 5411 THEN 0.15 WHEN 5812 THEN 0.30 WHEN 5912 THEN 0.20 WHEN 5944 THEN 0.45 WHEN 7801 THEN 0.80 WHEN 7802 THEN 0.75 WHEN 7995 THEN 0.85 WHEN 4511 THEN 0.35 WHEN 5311 THEN 0.25 ELSE 0.50 END"
_MCC = "CASE event_type WHEN 'click' THEN 5411 WHEN 'view' THEN 5812 WHEN 'signup' THEN 5912 WHEN 'purchase' THEN 7801 WHEN 'error' THEN 7995 END"
_F = f"""{_E},
f AS (SELECT event_id AS qid, event_type, CAST(value AS FLOAT) AS transaction_amount, k % 12 + 1 AS transaction_installments, CAST(hour(ts) AS INTEGER) AS transaction_hour, CAST(isodow(ts) - 1 AS INTEGER) AS transaction_day_of_week,
  CAST(20 + k AS FLOAT) AS customer_avg_amount, k % 25 AS customer_tx_count_24h,
  CASE WHEN k % 11 = 0 THEN true WHEN k % 2 = 0 THEN event_type NOT IN ('click', 'view') ELSE event_type <> 'purchase' END AS merchant_unknown,
  CAST({_RISK.format("CASE WHEN k % 7 <> 0 THEN " + _MCC + " END")} AS FLOAT) AS mcc_risk, coalesce(CASE WHEN k % 7 <> 0 THEN {_MCC} END, 0) AS merchant_mcc,
  CAST(k * 10.5 AS FLOAT) AS terminal_km_from_home, k % 2 = 0 AS terminal_is_online, k % 3 = 0 AS terminal_card_present, 0 AS terminal_known_merchants,
  CASE WHEN k % 4 <> 0 THEN CAST(greatest({_ISO_MIN.format("ts")} - {_ISO_MIN.format("date_trunc('second', ts - to_minutes(k * 3) - to_seconds(37))")}, 0) AS INTEGER) ELSE 0 END AS last_transaction_minutes,
  CASE WHEN k % 4 <> 0 THEN CAST(k * 2.25 AS FLOAT) ELSE CAST(0 AS FLOAT) END AS last_transaction_km_from_current, CAST(10 + k * 3 AS FLOAT) AS merchant_avg_amount, 0 AS requested_at_hour, k % 4 <> 0 AS has_last_transaction FROM e)"""


def _r(x: str, full: int) -> str:
    return f"greatest(least(CAST({x} AS FLOAT) / CAST({full} AS FLOAT), CAST(1 AS FLOAT)), CAST(0 AS FLOAT))"


_DIMS = [
    _r("transaction_amount", 10000), _r("transaction_installments", 12), f"CASE WHEN customer_avg_amount > 0 THEN {_r('CAST(transaction_amount / customer_avg_amount AS FLOAT)', 10)} ELSE CAST(0 AS FLOAT) END",
    "CAST(transaction_hour AS FLOAT) / CAST(23 AS FLOAT)", "CAST(transaction_day_of_week AS FLOAT) / CAST(6 AS FLOAT)",
    f"CASE WHEN has_last_transaction THEN {_r('last_transaction_minutes', 1440)} ELSE CAST(-1 AS FLOAT) END", f"CASE WHEN has_last_transaction THEN {_r('last_transaction_km_from_current', 1000)} ELSE CAST(-1 AS FLOAT) END",
    _r("terminal_km_from_home", 1000), _r("customer_tx_count_24h", 20), "CAST(CAST(terminal_is_online AS INTEGER) AS FLOAT)", "CAST(CAST(terminal_card_present AS INTEGER) AS FLOAT)", "CAST(CAST(merchant_unknown AS INTEGER) AS FLOAT)",
    "mcc_risk", _r("merchant_avg_amount", 10000),
]
_FV = f"{_F}, fv AS (SELECT qid, event_type, [{', '.join(f'CAST({x} AS FLOAT)' for x in _DIMS)}] AS v FROM f), ev AS (SELECT qid AS idx, event_type = 'error' AS is_fraud, [{_Q16} FOR x IN v] AS q FROM fv)"
_TX = f"{_FV}, pairs AS (SELECT a.idx AS qid, b.idx AS idx, b.is_fraud, {_dist('a.q', 'b.q')} AS dist FROM ev a, ev b WHERE a.idx % 100 = 0), nn AS {_top('pairs')}, {_SCORED}"

# the index over 16 clusters
_LCG = "n AS (SELECT count(*) AS n FROM refs), lcg AS (SELECT 0 AS i, CAST(305419896 AS BIGINT) AS s UNION ALL SELECT i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM lcg, n WHERE i < least(n, 50000)), draws AS (SELECT i - 1 AS draw, s % n AS pick FROM lcg, n WHERE i > 0)"
_CENTERS = f"""{_V}, {_LCG},
numbered AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS pos, v8 FROM refs),
cells AS (SELECT CAST(draw % 16 AS INTEGER) AS cluster_id, unnest(range(1, 15)) AS dim, unnest(v8) AS x FROM draws JOIN numbered ON pos = pick),
means AS (SELECT cluster_id, dim, CAST(round(CAST(sum(x) AS DOUBLE) / count(*)) AS INTEGER) AS m FROM cells GROUP BY ALL),
cen AS (SELECT CAST(r AS INTEGER) AS cluster_id, coalesce(cv, [0 FOR i IN range(14)]) AS cv FROM range(16) t(r) LEFT JOIN (SELECT cluster_id, list(m ORDER BY dim) AS cv FROM means GROUP BY cluster_id) USING (cluster_id))""".replace("range(16) t(r) LEFT JOIN (SELECT cluster_id, list(m ORDER BY dim) AS cv FROM means GROUP BY cluster_id) USING (cluster_id)", "range(16) t(r) LEFT JOIN (SELECT cluster_id, list(m ORDER BY dim) AS cv FROM means GROUP BY cluster_id) g ON g.cluster_id = r")


def _budget(name: str, probes: int, budget: int) -> str:
    """How far each of the first probes is scanned when what budget is left is shared among those to come."""
    share = f"CASE WHEN rest <= 0 THEN 0 ELSE least(s.cnt, greatest(rest // ({probes} - {name}.probe), 1), rest) END"
    return f"""{name} AS (SELECT qid, probe, cluster_id, least(cnt, greatest({budget} // {probes}, 1), {budget}) AS scan_len, {budget} - least(cnt, greatest({budget} // {probes}, 1), {budget}) AS rest FROM prob JOIN siz USING (cluster_id) WHERE probe = 1
        UNION ALL SELECT p.qid, p.probe, p.cluster_id, {share}, rest - {share}
        FROM {name} JOIN prob p ON p.qid = {name}.qid AND p.probe = {name}.probe + 1 JOIN siz s ON s.cluster_id = p.cluster_id WHERE p.probe <= {probes})"""


_INDEX = f"""{_CENTERS},
asg AS (SELECT idx, q, is_fraud, cluster_id FROM (SELECT idx, q, is_fraud, cluster_id, row_number() OVER (PARTITION BY idx ORDER BY {_dist('v8', 'cv')}, cluster_id) AS r FROM refs, cen) WHERE r = 1),
siz AS (SELECT CAST(r AS INTEGER) AS cluster_id, count(idx) AS cnt FROM range(16) t(r) LEFT JOIN asg ON cluster_id = r GROUP BY r),
off AS (SELECT cluster_id, CAST(coalesce(sum(cnt) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, cnt FROM siz),
laid AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY idx) - 1 AS pos_in_cluster FROM asg),
prob AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cdist, cluster_id) AS INTEGER) AS probe FROM (SELECT qid, q, cluster_id, {_dist('q8', 'cv')} AS cdist FROM qs, cen) QUALIFY probe <= 8),
mem AS (SELECT qid, laid.cluster_id, probe, pos_in_cluster, idx, is_fraud, {_dist('prob.q', 'laid.q')} AS dist FROM prob JOIN laid USING (cluster_id)),
{_budget('bud', 8, 100)}"""
_WITH_INDEX = f"WITH RECURSIVE {_INDEX}"
_PREFIX = f"inb AS (SELECT mem.* FROM mem JOIN bud USING (qid, cluster_id) WHERE pos_in_cluster < scan_len), first AS {_top('inb')}"


def _two_passes(probes: int, budget: int) -> str:
    """A vector enters the running top five if fewer than five scanned before are as near: no fold is needed to count those of each probe."""
    first = budget * 3 // 5
    return f"""{_budget('bud1', probes, first)},
pass1 AS (SELECT mem.*, row_number() OVER (PARTITION BY mem.qid ORDER BY mem.probe, pos_in_cluster) AS seq FROM mem JOIN bud1 ON bud1.qid = mem.qid AND bud1.cluster_id = mem.cluster_id WHERE pos_in_cluster < scan_len),
entered AS (SELECT a.qid, a.probe, a.seq, count(b.seq) < 5 AS ok FROM pass1 a LEFT JOIN pass1 b ON b.qid = a.qid AND b.seq < a.seq AND b.dist <= a.dist GROUP BY ALL),
gave AS (SELECT qid, probe, count(*) AS n FROM entered WHERE ok GROUP BY ALL),
two AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, probe DESC) AS r FROM gave QUALIFY r <= 2),
further AS (SELECT qid, probe, r, greatest({budget - first} * n // sum(n) OVER (PARTITION BY qid), 1) AS len FROM two),
pass2 AS (SELECT mem.*, 1000000000 * r + pos_in_cluster AS seq FROM mem JOIN further ON further.qid = mem.qid AND further.probe = mem.probe WHERE pos_in_cluster < len),
seen AS (SELECT qid, idx, is_fraud, dist, min(seq) AS seq FROM (FROM pass1 UNION ALL FROM pass2) GROUP BY ALL),
first AS (SELECT qid, idx, is_fraud FROM seen QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, seq) <= 5)"""


def _orchestrated(probes: int, budget: int) -> str:
    return f"""{_WITH_INDEX}, {_two_passes(probes, budget)},
few AS (SELECT qs.qid FROM qs LEFT JOIN first USING (qid) GROUP BY qs.qid HAVING count(idx) < 5),
pairs AS (SELECT qid, idx, is_fraud, {_dist('qs.q', 'refs.q')} AS dist FROM qs, refs WHERE qid IN (FROM few)), exact5 AS {_top('pairs')},
found AS (SELECT qid, is_fraud FROM first WHERE qid NOT IN (FROM few) UNION ALL SELECT qid, is_fraud FROM exact5),
mix AS (SELECT qid FROM found GROUP BY qid HAVING count(*) = 5 AND sum(is_fraud::INT) BETWEEN 1 AND 4),
near AS (SELECT * FROM mem WHERE probe <= {probes}), full5 AS {_top('near')},
nn AS (SELECT qid, is_fraud FROM found WHERE qid NOT IN (FROM mix) UNION ALL SELECT qid, is_fraud FROM full5 WHERE qid IN (FROM mix)), {_SCORED}
SELECT qid, coalesce(fraud, 0) AS fraud, coalesce(cnt, 0) AS cnt, coalesce(fraud / cnt, 0.0) AS fraud_score, coalesce(fraud * 5 < cnt * 3, true) AS approved FROM qs LEFT JOIN sc USING (qid)"""


# log lines out of events
_LB = f"""{_E}, lb0 AS (SELECT event_id, 'r' || (event_id // 2) AS req_id, CASE WHEN k % 9 = 0 THEN 503 ELSE 200 END AS st, k % 5 AS Tq, k % 8 - 1 AS Tw, 1 AS Tc, k % 40 AS Tr, k % 40 + k % 8 + 3 AS Tt FROM e WHERE k % 31 <> 0),
lb AS (SELECT * EXCLUDE (event_id) FROM lb0 QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY event_id DESC) = 1)"""
_TR0 = """tr0 AS (SELECT event_id, event_id % 2 AS source, 'r' || (event_id // 3) AS req_id, CAST(k * 3 AS DOUBLE) AS t_read_us, CAST(k * 7 + 11 AS DOUBLE) AS t_parse_us, CASE WHEN k % 6 <> 0 THEN CAST(k * 50 AS DOUBLE) END AS t_eval_us, CAST(k + 5 AS DOUBLE) AS t_resp_us, CAST(k * 61 + 16 AS DOUBLE) AS t_total_us FROM e WHERE k % 17 <> 0 AND k % 37 <> 0)"""
_TR = f"{_TR0}, tr AS (SELECT * EXCLUDE (event_id) FROM tr0 QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY source DESC, event_id DESC) = 1)"
_FACTS = f"""{_LB}, {_TR}, facts AS (SELECT req_id, CAST(greatest(Tq, Tw) AS DOUBLE) AS lb_qw_ms, CAST(Tr AS DOUBLE) AS lb_tr_ms, CAST(Tt AS DOUBLE) AS lb_tt_ms, coalesce(t_read_us, 0) / 1000.0 AS go_read_ms, coalesce(t_parse_us, 0) / 1000.0 AS go_parse_ms,
  coalesce(t_eval_us, 0) / 1000.0 AS go_eval_ms, coalesce(t_resp_us, 0) / 1000.0 AS go_resp_ms, coalesce(t_total_us, 0) / 1000.0 AS go_total_ms, CAST(Tt AS DOUBLE) - coalesce(t_total_us, 0) / 1000.0 AS non_go_overhead_ms, st AS status FROM lb JOIN tr USING (req_id))"""
_METRICS = ("lb_qw_ms", "lb_tr_ms", "lb_tt_ms", "go_read_ms", "go_parse_ms", "go_eval_ms", "go_resp_ms", "go_total_ms", "non_go_overhead_ms")
_PCT = "pct AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {i} AS place, coalesce(quantile_cont({m}, 0.5), 0.0) AS p50, coalesce(quantile_cont({m}, 0.95), 0.0) AS p95, coalesce(quantile_cont({m}, 0.99), 0.0) AS p99 FROM facts" for i, m in enumerate(_METRICS, 1)) + ")"
_BOTTLE = """bn AS (SELECT CASE WHEN e > q AND e > p THEN 'zig_eval' WHEN p > q AND p > e THEN 'go_parse' ELSE 'lb_queue_or_wait' END AS bottleneck, q AS p99_queue, e AS p99_eval, p AS p99_parse
  FROM (SELECT max(p99) FILTER (metric = 'lb_qw_ms') AS q, max(p99) FILTER (metric = 'go_eval_ms') AS e, max(p99) FILTER (metric = 'go_parse_ms') AS p FROM pct))"""

_FEATURES = ("transaction_amount", "transaction_installments", "transaction_hour", "transaction_day_of_week", "customer_avg_amount", "customer_tx_count_24h", "merchant_unknown", "mcc_risk", "merchant_mcc", "terminal_km_from_home", "terminal_is_online", "terminal_card_present", "terminal_known_merchants", "last_transaction_minutes", "last_transaction_km_from_current", "merchant_avg_amount", "requested_at_hour", "has_last_transaction")
_REAL = {"transaction_amount", "customer_avg_amount", "mcc_risk", "terminal_km_from_home", "last_transaction_km_from_current", "merchant_avg_amount"}

ORACLE_SQL = {
    "quantize_i16": f"WITH {_V} SELECT idx, array_to_string(q, ',') AS q FROM v",
    "quantize_i8": f"WITH {_V} SELECT idx, array_to_string(v8, ',') AS q8 FROM v",
    "requantize_i8": f"WITH {_V} SELECT idx, array_to_string([greatest(-128, least(127, x // 258)) FOR x IN q], ',') AS q8 FROM v",
    "sq_l2_distance": f"WITH {_V} SELECT a.idx AS idx, {_dist('a.q', 'b.q')} AS dist FROM v a JOIN v b ON b.idx = a.idx + 1",
    "exact_knn_top5": f"WITH {_EXACT} SELECT qid, rank, idx, dist FROM nn",
    "knn_votes": f"WITH {_EXACT}, {_SCORED} SELECT qid, fraud, cnt FROM sc",
    "knn_fraud_score": f"WITH {_EXACT}, {_SCORED} SELECT qid, fraud / cnt AS fraud_score, fraud * 5 < cnt * 3 AS approved FROM sc",
    "knn_decision_json": f"WITH {_EXACT}, {_SCORED} SELECT qid, {_RESPONSE} AS response FROM sc",
    "payload_parse": f"WITH {_F} SELECT qid, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' if c in _REAL else c for c in _FEATURES)} FROM f",
    "payload_defaults": f"WITH {_E} SELECT event_id AS qid, CASE WHEN k % 2 = 0 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS amount, true AS merchant_unknown, 0.5::DOUBLE AS mcc_risk, false AS terminal_is_online, false AS has_last_transaction, 0 AS transaction_hour, 0 AS last_transaction_minutes FROM e",
    "ts_hour_dow": f"SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, {_ISO_MIN.format('ts')} AS minutes FROM events",
    "minutes_since_last": "SELECT event_id, CAST(coalesce(greatest(datediff('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts), 0), 0) AS INTEGER) AS minutes FROM events",
    "fnv1a_hash": "SELECT event_id, list_reduce(list_prepend(2166136261::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(event_type || '-' || event_id, '')]), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS hash FROM events",
    "merchant_unknown": f"WITH {_E} SELECT event_id, k % 40 + 1 >= 32 AS unknown FROM e",
    "mcc_risk_lookup": f"WITH {_E}, m AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN 0 ELSE {_MCC} END AS mcc FROM e) SELECT event_id, mcc, round(CAST(CAST({_RISK.format('mcc')} AS FLOAT) AS DOUBLE), 6) AS risk FROM m",
    "feature_vector": f"WITH {_FV} SELECT qid, CAST(unnest(range(14)) AS INTEGER) AS dim, round(CAST(unnest(v) AS DOUBLE), 6) AS x FROM fv",
    "feature_vector_q16": f"WITH {_FV} SELECT idx AS qid, array_to_string(q, ',') AS q FROM ev",
    "transaction_fraud_score": f"WITH {_TX} SELECT qid, fraud, fraud / cnt AS fraud_score, fraud * 5 < cnt * 3 AS approved, {_RESPONSE} AS response FROM sc",
    "udf_score_eval": f"WITH {_TX} SELECT qid, fraud / cnt AS fraud_score, 0 AS err FROM sc",
    "lcg_sample": f"WITH RECURSIVE {_V}, {_LCG} SELECT CAST(draw AS BIGINT) AS draw, CAST(pick AS BIGINT) AS pick FROM draws",
    "centroids": f"WITH RECURSIVE {_CENTERS} SELECT cluster_id, array_to_string(cv, ',') AS cv FROM cen",
    "cluster_assign": f"{_WITH_INDEX} SELECT idx, cluster_id FROM asg",
    "cluster_sizes": f"{_WITH_INDEX} SELECT cluster_id, cnt FROM siz",
    "cluster_offsets": f'{_WITH_INDEX} SELECT cluster_id, s AS start, s + cnt AS "end" FROM off',
    "cluster_layout": f"{_WITH_INDEX} SELECT idx, cluster_id, pos_in_cluster, s + pos_in_cluster AS pos FROM laid JOIN off USING (cluster_id)",
    "ivf_probe": f"{_WITH_INDEX} SELECT qid, probe, cluster_id, cdist FROM prob",
    "ivf_budget": f"{_WITH_INDEX} SELECT qid, probe, cluster_id, CAST(scan_len AS BIGINT) AS scan_len FROM bud",
    "ivf_budgeted_knn": f"{_WITH_INDEX}, {_PREFIX} SELECT qid, rank, idx, dist FROM first",
    "ivf_knn": f"{_WITH_INDEX}, nn AS {_top('mem')} SELECT qid, rank, idx, dist FROM nn",
    "ivf_score": f"""{_WITH_INDEX}, {_PREFIX}, full5 AS {_top('mem')}, mix AS (SELECT qid FROM first GROUP BY qid HAVING count(*) = 5 AND sum(is_fraud::INT) BETWEEN 1 AND 4),
nn AS (SELECT qid, is_fraud FROM first WHERE qid NOT IN (FROM mix) UNION ALL SELECT qid, is_fraud FROM full5 WHERE qid IN (FROM mix)), {_SCORED}
SELECT qid, coalesce(fraud, 0) AS fraud, coalesce(fraud / cnt, 0.0) AS fraud_score, coalesce(fraud * 5 < cnt * 3, true) AS approved FROM qs LEFT JOIN sc USING (qid)""",
    "ivf_fallback": f"WITH {_EXACT} SELECT qid, rank, idx, dist FROM nn",
    "ivf_recall": f"{_WITH_INDEX}, five AS {_top('mem')}, pairs AS (SELECT qid, idx, is_fraud, {_dist('qs.q', 'refs.q')} AS dist FROM qs, refs), nn AS {_top('pairs')} SELECT count(*) AS expected, count(five.idx) AS found, count(five.idx) / count(*) AS recall FROM nn LEFT JOIN five ON nn.qid = five.qid AND nn.idx = five.idx",
    "ivf_two_pass_compat": f"{_WITH_INDEX}, {_two_passes(8, 100)}, nn AS (FROM first), {_SCORED} SELECT qid, fraud, cnt, fraud / cnt AS fraud_score FROM sc",
    "ivf_orchestrated": _orchestrated(8, 100),
    "ivf_orchestrated_sparse": _orchestrated(1, 6),
    "scan_stats": f"{_WITH_INDEX} SELECT count(DISTINCT qid) AS requests, count(*) AS probes, CAST(sum(scan_len) AS BIGINT) AS scanned FROM bud",
    "request_status": f"""WITH {_E} SELECT event_id, CASE WHEN k % 17 = 0 THEN 404 WHEN k % 10 = 0 THEN 200 WHEN k % 5 = 0 THEN 404 WHEN k % 7 = 0 OR k % 13 = 0 THEN 405
 WHEN k % 19 = 0 OR k % 23 = 0 THEN 413 WHEN k % 29 = 0 THEN 503 ELSE 200 END AS status FROM e""",
    "round_robin_backend": "SELECT event_id, CAST(event_id % 2 AS INTEGER) AS backend FROM events",
    "bitpack_roundtrip": f"""WITH {_E}, p AS (SELECT event_id, CAST(k % 8 AS BIGINT) AS op, (event_id * 2654435) % 4294967296 AS generation, user_id % 16777216 AS conn FROM e)
SELECT event_id, op * 72057594037927936 + generation * 16777216 + conn AS tag, op, generation, conn FROM p""",
    "lb_log_parse": f"WITH {_LB} SELECT * FROM lb",
    "trace_parse": f"WITH {_E}, {_TR0} SELECT * EXCLUDE (event_id, source) FROM tr0 WHERE source = 0 QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY event_id DESC) = 1",
    "trace_union_last_wins": f"WITH {_E}, {_TR} SELECT req_id, CAST(source AS INTEGER) AS source, t_read_us, t_parse_us, t_eval_us, t_resp_us, t_total_us FROM tr",
    "latency_join": f"WITH {_FACTS} SELECT * FROM facts",
    "latency_percentiles": f"WITH {_FACTS}, {_PCT} SELECT metric, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM pct",
    "latency_top5": f"WITH {_FACTS} SELECT req_id, lb_tt_ms, go_total_ms, status FROM facts ORDER BY lb_tt_ms DESC, req_id LIMIT 5",
    "latency_bottleneck": f"WITH {_FACTS}, {_PCT}, {_BOTTLE} SELECT bottleneck, round(p99_queue, 6) AS p99_queue, round(p99_eval, 6) AS p99_eval, round(p99_parse, 6) AS p99_parse FROM bn",
    "latency_report_md": f"""WITH {_FACTS}, {_PCT}, {_BOTTLE}, t5 AS (SELECT *, row_number() OVER (ORDER BY lb_tt_ms DESC, req_id) AS r FROM facts QUALIFY r <= 5)
SELECT * FROM (VALUES ('0-00', '# E2E Latency Report'), ('0-01', '- Input dir: `events`'), ('1-00', ''), ('1-01', '## Percentiles (ms)'), ('1-02', '| metric | p50 | p95 | p99 |'), ('1-03', '|---|---:|---:|---:|'),
  ('2-00', ''), ('2-01', '## Top 5 Tail Requests (by lb_tt_ms)'), ('2-02', '| req_id | status | lb_tt_ms | lb_qw_ms | lb_tr_ms | go_total_ms | go_eval_ms | non_go_overhead_ms |'), ('2-03', '|---|---:|---:|---:|---:|---:|---:|---:|'),
  ('3-00', ''), ('3-01', '## Conclusion')) fixed(part, line)
UNION ALL SELECT '0-02', '- Joined requests: `' || count(*) || '`' FROM facts
UNION ALL SELECT '1-' || lpad((place + 3)::VARCHAR, 2, '0'), '| ' || metric || ' | ' || printf('%.3f', p50) || ' | ' || printf('%.3f', p95) || ' | ' || printf('%.3f', p99) || ' |' FROM pct
UNION ALL SELECT '2-' || lpad((r + 3)::VARCHAR, 2, '0'), '| ' || '`' || req_id || '` | ' || status || ' | ' || printf('%.3f', lb_tt_ms) || ' | ' || printf('%.3f', lb_qw_ms) || ' | ' || printf('%.3f', lb_tr_ms) || ' | ' || printf('%.3f', go_total_ms) || ' | ' || printf('%.3f', go_eval_ms) || ' | ' || printf('%.3f', non_go_overhead_ms) || ' |' FROM t5
UNION ALL SELECT '3-02', '- Dominant bottleneck candidate: `' || bottleneck || '`' FROM bn
UNION ALL SELECT '3-03', '- p99 lb_qw_ms: `' || printf('%.3f', p99_queue) || '`' FROM bn
UNION ALL SELECT '3-04', '- p99 go_eval_ms: `' || printf('%.3f', p99_eval) || '`' FROM bn
UNION ALL SELECT '3-05', '- p99 go_parse_ms: `' || printf('%.3f', p99_parse) || '`' FROM bn""",
    "rolling_features": """SELECT event_id, count(*) OVER w AS tx_count_24h, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER w, 0) AS BIGINT) AS cents_24h FROM (SELECT *, epoch_us(ts) AS us FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)""",
    "stream_score": f"WITH {_TX} SELECT qid, fraud / cnt AS fraud_score, fraud * 5 < cnt * 3 AS approved FROM sc",
    "stream_rolling_features": "SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL",
}
