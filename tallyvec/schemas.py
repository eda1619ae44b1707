"""Explicit schemas; nothing is inferred."""

PAYLOAD = (
    "requested_at string, transaction struct<amount:double,installments:double,requested_at:string>, "
    "customer struct<avg_amount:double,tx_count_24h:double,known_merchants:array<string>>, "
    "merchant struct<id:string,mcc:string,avg_amount:double>, "
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:double,known_merchants:double>, "
    "last_transaction struct<timestamp:string,km_from_current:double>"
)
REFERENCES = "vector array<float>, label string"
TRACE = "kind string, req_id string, t_read_us double, t_parse_us double, t_eval_us double, t_resp_us double, t_total_us double"
