import json

import pytest
from pyspark.sql import functions as F

from tallyvec.functions import features, transport, vectors

SAMPLE = {
    "transaction": {"amount": 2508.13, "installments": 7, "requested_at": "2026-03-11T03:45:53Z"},
    "customer": {"avg_amount": 209.74, "tx_count_24h": 13, "known_merchants": ["MERC-003", "MERC-016"]},
    "merchant": {"id": "MERC-089", "mcc": "7801", "avg_amount": 25.15},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 667.7296579973},
    "last_transaction": None,
}


def _featured(spark, *payloads):
    rows = [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return features.with_features(features.parse(spark.createDataFrame(rows, "qid bigint, body string")))


def test_sample_payload(spark):
    rows = _featured(spark, SAMPLE)
    r = rows.first()
    assert (r.transaction_hour, r.transaction_day_of_week, r.merchant_unknown, r.has_last_transaction) == (3, 2, True, False)
    assert round(r.mcc_risk, 6) == 0.8
    assert rows.select(features.vector_of(rows).alias("q")).first().q == [8218, 19114, 32767, 4274, 10922, -32767, -32767, 21879, 21299, 0, 32767, 32767, 26214, 82]


def test_payload_cases(spark):
    last = SAMPLE | {"last_transaction": {"timestamp": "2026-03-11T03:40:59Z", "km_from_current": 12.5}}
    month = SAMPLE | {"transaction": SAMPLE["transaction"] | {"requested_at": "2026-03-01T00:01:00Z"}, "last_transaction": {"timestamp": "2026-02-28T23:59:30Z", "km_from_current": 1}}
    year = SAMPLE | {"transaction": SAMPLE["transaction"] | {"requested_at": "2026-01-01T00:00:00Z"}, "last_transaction": {"timestamp": "2025-12-31T23:00:00Z", "km_from_current": 1}}
    later = SAMPLE | {"last_transaction": {"timestamp": "2027-01-01T00:00:00Z", "km_from_current": 1}}
    no_mcc = SAMPLE | {"merchant": {"id": "MERC-003"}}
    no_id = SAMPLE | {"merchant": {"mcc": "1234"}}
    many = SAMPLE | {"customer": {"avg_amount": 0, "known_merchants": [f"m{i}" for i in range(32)] + ["MERC-089"]}}
    rows = _featured(spark, last, month, year, later, no_mcc, no_id, many, "", "{}", "not json").orderBy("qid").collect()
    assert [r.last_transaction_minutes for r in rows[:4]] == [5, 2, 60, 0] and all(r.has_last_transaction for r in rows[:4])
    assert (round(rows[4].mcc_risk, 6), rows[4].merchant_unknown) == (0.5, False)
    assert (round(rows[5].mcc_risk, 6), rows[5].merchant_unknown) == (0.5, True)
    assert rows[6].merchant_unknown and rows[6].customer_avg_amount == 0
    for r in rows[7:]:
        assert r.merchant_unknown and round(r.mcc_risk, 6) == 0.5 and r.transaction_amount == 0 and not r.has_last_transaction


def test_clamps(spark):
    big = SAMPLE | {"transaction": {"amount": 99999, "installments": 3}, "customer": {"avg_amount": 0}, "terminal": {"km_from_home": -5}}
    rows = _featured(spark, big)
    q = rows.select(features.vector_of(rows).alias("q")).first().q
    assert q[0] == 32767 and q[2] == 0 and q[7] == 0


@pytest.mark.parametrize("text, want", [("MERC-003", 3734829904), ("", 2166136261)])
def test_fnv1a(spark, text, want):
    assert spark.range(1).select(features.fnv1a(F.lit(text)).alias("h")).first().h == want


def test_requantize_truncates(spark):
    got = spark.createDataFrame([(x,) for x in (32767, -32767, -300, 257, -32768)], "x smallint").select(vectors.i16_to_i8(F.col("x")).alias("y"))
    assert [r.y for r in got.collect()] == [127, -127, -1, 0, -127]


def test_distance_is_exact_beyond_16_bits(spark):
    df = spark.createDataFrame([([-32767] * 14, [32767] * 14)], "a array<smallint>, b array<smallint>")
    assert df.select(vectors.squared_distance(F.col("a"), F.col("b")).alias("d")).first().d == 14 * 65534**2


def test_vector_pads_and_cuts(spark):
    df = spark.createDataFrame([([1.0] * 20,), ([0.5],), (None,)], "v array<float>")
    assert [len(r.v) for r in df.select(vectors.vector(F.col("v")).alias("v")).collect()] == [14, 14, 14]


def test_statuses_and_tags(spark):
    rows = [("GET", "/ready", True, 0, 0, 200), ("GET", "/x", True, 0, 0, 404), ("PUT", "/fraud-score", True, 5, 5, 405), ("POST", "/fraud-score", True, 0, 0, 413), ("POST", "/fraud-score", True, 65537, 65537, 413), ("POST", "/fraud-score", True, 10, 9, 503), ("POST", "/fraud-score", True, 10, 10, 200), ("POST", "/fraud-score", False, 10, 10, 404)]
    df = spark.createDataFrame(rows, "m string, p string, h boolean, n int, b int, want int")
    c = F.col
    assert all(r.s == r.want for r in df.withColumn("s", transport.status(c("m"), c("p"), c("h"), c("n"), c("b"))).collect())
    tag = spark.createDataFrame([(255, 2**32 - 1, 2**24 - 1), (1, 2, 3)], "o bigint, g bigint, i bigint").withColumn("t", transport.pack_tag(c("o"), c("g"), c("i")))
    assert all((r.o, r.g, r.i) == (r.a, r.b, r.d) for r in tag.select("o", "g", "i", *(x.alias(n) for x, n in zip(transport.unpack_tag(c("t")), "abd"))).collect())


def test_response(spark):
    assert spark.range(1).select(transport.response(F.lit(True), F.lit(0.4)).alias("r")).first().r == '{"approved":true,"fraud_score":0.400000}'
