"""Transactions: JSON payload to features, features to the normalized vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from . import vectors

KNOWN_MERCHANTS = 32
# fixed values: merchant category risks, risk of all others, and what full scale means for each normalized feature
MCC_RISK = {5411: 0.15, 5812: 0.30, 5912: 0.20, 5944: 0.45, 7801: 0.80, 7802: 0.75, 7995: 0.85, 4511: 0.35, 5311: 0.25, 5999: 0.50}
OTHER_RISK = 0.50
MAX_AMOUNT, MAX_INSTALLMENTS, MAX_RATIO, MAX_MINUTES, MAX_KM, MAX_COUNT_24H, MAX_MERCHANT_AVG = 10000.0, 12.0, 10.0, 1440.0, 1000.0, 20.0, 10000.0


def hour_of(iso: Column) -> Column:
    """Of ISO text, whatever its zone."""
    return F.coalesce(F.substring(iso, 12, 2).try_cast("int"), F.lit(0))


def day_of(iso: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(iso, 1, 10), F.lit("yyyy-MM-dd")))


def day_of_week(iso: Column) -> Column:
    """Monday 0 to Sunday 6; 0 where there's no date."""
    return F.coalesce(F.weekday(day_of(iso)), F.lit(0))


def minutes_of(iso: Column) -> Column:
    """Minutes since 1970, seconds and zone ignored; null for text of under 16 characters."""
    whole = F.unix_date(day_of(iso)).cast("bigint") * 1440 + F.substring(iso, 12, 2).try_cast("bigint") * 60 + F.substring(iso, 15, 2).try_cast("bigint")
    return F.when(F.length(iso) >= 16, whole)


def minutes_between(now: Column, before: Column) -> Column:
    """At least 0; 0 if either is missing."""
    return F.coalesce(F.greatest(minutes_of(now) - minutes_of(before), F.lit(0)), F.lit(0)).cast("int")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as bigint."""
    raw = F.encode(text, "utf-8")
    bytes_ = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint"))
    start = F.lit(2166136261).cast("bigint")
    return F.when(F.length(raw) == 0, start).otherwise(F.aggregate(bytes_, start, lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295))))


def merchant_unknown(known: Column, merchant: Column) -> Column:
    """Whether the merchant isn't among the first 32 known; true without a merchant id."""
    listed = F.array_contains(F.slice(F.coalesce(known, F.array().cast("array<string>")), 1, KNOWN_MERCHANTS), merchant)
    return F.when(F.coalesce(merchant, F.lit("")) == "", F.lit(True)).otherwise(~F.coalesce(listed, F.lit(False)))


def mcc_number(mcc: Column) -> Column:
    return F.coalesce(F.regexp_replace(mcc, "[^0-9]", "").try_cast("int"), F.lit(0))


def mcc_risk(number: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MCC_RISK.items() for x in pair))
    return F.coalesce(F.element_at(table, number), F.lit(OTHER_RISK)).cast("float")


def features(payload: Column) -> dict[str, Column]:
    """The flat features of a parsed payload, by name, with their defaults."""
    f = lambda path: payload.getField(path.split(".")[0]).getField(path.split(".")[1])
    real = lambda path: F.coalesce(f(path), F.lit(0.0)).cast("float")
    whole = lambda path: F.coalesce(f(path), F.lit(0.0)).cast("int")
    flag = lambda path: F.coalesce(f(path), F.lit(False))
    at, last = f("transaction.requested_at"), payload.getField("last_transaction")
    number = mcc_number(f("merchant.mcc"))
    return {
        "transaction_amount": real("transaction.amount"),
        "transaction_installments": whole("transaction.installments"),
        "transaction_hour": hour_of(at),
        "transaction_day_of_week": day_of_week(at),
        "customer_avg_amount": real("customer.avg_amount"),
        "customer_tx_count_24h": whole("customer.tx_count_24h"),
        "merchant_unknown": merchant_unknown(f("customer.known_merchants"), f("merchant.id")),
        "mcc_risk": F.when(f("merchant.mcc").isNull(), F.lit(OTHER_RISK).cast("float")).otherwise(mcc_risk(number)),
        "merchant_mcc": number,
        "terminal_km_from_home": real("terminal.km_from_home"),
        "terminal_is_online": flag("terminal.is_online"),
        "terminal_card_present": flag("terminal.card_present"),
        "terminal_known_merchants": whole("terminal.known_merchants"),
        "last_transaction_minutes": minutes_between(at, f("last_transaction.timestamp")),
        "last_transaction_km_from_current": real("last_transaction.km_from_current"),
        "merchant_avg_amount": real("merchant.avg_amount"),
        "requested_at_hour": hour_of(payload.getField("requested_at")),
        "has_last_transaction": last.isNotNull() & (F.coalesce(last.getField("timestamp"), last.getField("km_from_current").cast("string")).isNotNull()),
    }


def parse(requests: DataFrame, body: str = "body") -> DataFrame:
    """requests with a parsed payload in place of the JSON body."""
    return requests.withColumn("payload", F.from_json(F.col(body), schemas.PAYLOAD)).drop(body)


def with_features(parsed: DataFrame) -> DataFrame:
    return parsed.withColumns(features(F.col("payload"))).drop("payload")


def _ratio(x: Column, full: float) -> Column:
    """x / full as 32-bit float, clamped to 0 .. 1."""
    r = (x.cast("float") / F.lit(full).cast("float")).cast("float")
    return F.greatest(F.least(r, F.lit(1.0).cast("float")), F.lit(0.0).cast("float"))


def normalized() -> Column:
    """The vector of 14 reals from the feature columns."""
    c = F.col
    zero, minus = F.lit(0.0).cast("float"), F.lit(-1.0).cast("float")
    ratio = (c("transaction_amount") / F.when(c("customer_avg_amount") > 0, c("customer_avg_amount"))).cast("float")
    flag = lambda name: c(name).cast("int").cast("float")
    return F.array(
        _ratio(c("transaction_amount"), MAX_AMOUNT),
        _ratio(c("transaction_installments"), MAX_INSTALLMENTS),
        F.when(c("customer_avg_amount") > 0, _ratio(ratio, MAX_RATIO)).otherwise(zero),
        (c("transaction_hour").cast("float") / F.lit(23.0).cast("float")).cast("float"),
        (c("transaction_day_of_week").cast("float") / F.lit(6.0).cast("float")).cast("float"),
        F.when(c("has_last_transaction"), _ratio(c("last_transaction_minutes"), MAX_MINUTES)).otherwise(minus),
        F.when(c("has_last_transaction"), _ratio(c("last_transaction_km_from_current"), MAX_KM)).otherwise(minus),
        _ratio(c("terminal_km_from_home"), MAX_KM),
        _ratio(c("customer_tx_count_24h"), MAX_COUNT_24H),
        flag("terminal_is_online"),
        flag("terminal_card_present"),
        flag("merchant_unknown"),
        c("mcc_risk"),
        _ratio(c("merchant_avg_amount"), MAX_MERCHANT_AVG),
    )


def vector_of(featured: DataFrame) -> Column:
    """The int16 vector of the feature columns."""
    return vectors.vector_i16(normalized())
