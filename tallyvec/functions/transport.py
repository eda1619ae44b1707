"""What remains of the request transport: status codes, routing, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BODY = 64 * 1024


def status(method: Column, path: Column, header_ends: Column, length: Column, body: Column) -> Column:
    """HTTP status of a request: header_ends (whether its header is complete), length (declared), body (bytes received)."""
    return (
        F.when(~F.coalesce(header_ends, F.lit(False)), 404)
        .when((method == "GET") & (path == "/ready"), 200)
        .when(method == "GET", 404)
        .when((method != "POST") | (path != "/fraud-score"), 405)
        .when((F.coalesce(length, F.lit(0)) <= 0) | (length > MAX_BODY), 413)
        .when(F.coalesce(body, F.lit(0)) < length, 503)
        .otherwise(200)
    )


def backend(position: Column, backends: int = 2) -> Column:
    """Round robin by arrival, from 0."""
    return F.pmod(position, F.lit(backends)).cast("int")


def pack_tag(op: Column, generation: Column, conn: Column) -> Column:
    """Eight bits of op, 32 of generation, 24 of connection id in one bigint."""
    part = lambda x, bits: x.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftleft(part(op, 8), 56).bitwiseOR(F.shiftleft(part(generation, 32), 24)).bitwiseOR(part(conn, 24))


def unpack_tag(tag: Column) -> tuple[Column, Column, Column]:
    mask = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftrightunsigned(tag, 56), mask(F.shiftrightunsigned(tag, 24), 32), mask(tag, 24)


def response(approved: Column, score: Column) -> Column:
    return F.to_json(F.struct(approved.alias("approved"), score.cast("decimal(7,6)").alias("fraud_score")))
