"""Latency analytics: parse two kinds of log lines, join them by request, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

# fixed value: one access-log line of the load balancer: request id, status and five timers
ACCESS = r"req_id=(\S+) .*? st=(\d+) Tq=(-?\d+) Tw=(-?\d+) Tc=(-?\d+) Tr=(-?\d+) Tt=(-?\d+)"
TRACE_START = '{"kind":"req_trace"'
METRICS = ("lb_qw_ms", "lb_tr_ms", "lb_tt_ms", "go_read_ms", "go_parse_ms", "go_eval_ms", "go_resp_ms", "go_total_ms", "non_go_overhead_ms")


def parse_access(lines: DataFrame) -> DataFrame:
    """lines: (line_no, value). req_id, st, Tq, Tw, Tc, Tr, Tt of matching lines; the last line of a request counts."""
    parts = lines.where(F.col("value").rlike(ACCESS)).select("line_no", F.regexp_extract("value", ACCESS, 1).alias("req_id"), *(F.regexp_extract("value", ACCESS, i + 2).cast("int").alias(n) for i, n in enumerate(("st", "Tq", "Tw", "Tc", "Tr", "Tt"))))
    return last_wins(parts, ["line_no"]).drop("line_no")


def parse_trace(lines: DataFrame) -> DataFrame:
    """lines: (source, line_no, value). The fields of well-formed trace lines with a request id; later sources and lines win."""
    at = F.instr("value", TRACE_START)
    body = F.trim(F.col("value").substr(at, F.length("value")))
    # the object must end its line: with text after it, what is wrapped around it can't be read to its end
    whole = F.from_json(F.concat(F.lit('{"t":'), body, F.lit(',"end":true}')), f"t struct<{schemas.TRACE}>, end boolean", {"mode": "PERMISSIVE"})
    parsed = lines.where(at > 0).select("source", "line_no", F.explode(F.array(whole)).alias("w")).where("w.end").select("source", "line_no", "w.t.*")
    kept = parsed.where(F.coalesce("req_id", F.lit("")) != "")
    return last_wins(kept, ["source", "line_no"]).drop("line_no", "kind")


def last_wins(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each req_id, the last by order; combined before it is shuffled."""
    rest = [c for c in rows.columns if c != "req_id"]
    last = rows.groupBy("req_id").agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_r"))
    return last.select("req_id", *(F.col(f"_r.{c}").alias(c) for c in rest))


def joined(access: DataFrame, trace: DataFrame, unit: str = "us") -> DataFrame:
    """The latency facts of requests in both logs; the timers of the access log are in unit (us or ms)."""
    timer = lambda c: c / F.lit(1000.0) if unit == "us" else c.cast("double")
    span = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.lit(1000.0)
    return access.join(trace, "req_id").select(
        "req_id",
        timer(F.greatest("Tq", "Tw")).alias("lb_qw_ms"),
        timer(F.col("Tr")).alias("lb_tr_ms"),
        timer(F.col("Tt")).alias("lb_tt_ms"),
        span("t_read_us").alias("go_read_ms"),
        span("t_parse_us").alias("go_parse_ms"),
        span("t_eval_us").alias("go_eval_ms"),
        span("t_resp_us").alias("go_resp_ms"),
        span("t_total_us").alias("go_total_ms"),
        (timer(F.col("Tt")) - span("t_total_us")).alias("non_go_overhead_ms"),
        F.col("st").alias("status"),
    )


def percentiles(facts: DataFrame) -> DataFrame:
    """metric, p50, p95, p99: exact, interpolated; 0.0 without facts."""
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    long = facts.selectExpr(f"stack({len(METRICS)}, {pairs}) AS (metric, v)")
    summed = long.groupBy("metric").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    every = facts.sparkSession.createDataFrame([(m,) for m in METRICS], "metric string")
    at = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(0.0))
    return every.join(summed, "metric", "left").select("metric", at(0).alias("p50"), at(1).alias("p95"), at(2).alias("p99"))


def slowest(facts: DataFrame, n: int = 5) -> DataFrame:
    return facts.orderBy(F.desc("lb_tt_ms"), "req_id").limit(n)


def bottleneck(summary: DataFrame) -> DataFrame:
    """One row: which of queue, evaluation and parsing has strictly the highest 99th percentile; the queue otherwise."""
    p = {m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("p99"))), F.lit(0.0)) for m in ("lb_qw_ms", "go_eval_ms", "go_parse_ms")}
    row = summary.agg(*(v.alias(k) for k, v in p.items()))
    queue, eval_, parse = F.col("lb_qw_ms"), F.col("go_eval_ms"), F.col("go_parse_ms")
    name = F.when((eval_ > queue) & (eval_ > parse), "zig_eval").when((parse > queue) & (parse > eval_), "go_parse").otherwise("lb_queue_or_wait")
    return row.select(name.alias("bottleneck"), queue.alias("p99_queue"), eval_.alias("p99_eval"), parse.alias("p99_parse"))


# fixed values: headings and column names of the report
TITLE, SUMMARY_HEAD, TAIL_HEAD, END_HEAD = "# E2E Latency Report", "## Percentiles (ms)", "## Top 5 Tail Requests (by lb_tt_ms)", "## Conclusion"
SUMMARY_COLUMNS, TAIL_TIMES = ("metric", "p50", "p95", "p99"), ("lb_tt_ms", "lb_qw_ms", "lb_tr_ms", "go_total_ms", "go_eval_ms", "non_go_overhead_ms")


def report_lines(facts: DataFrame, source: str = "logs") -> DataFrame:
    """part, line: the report as Markdown lines, in order of part; source is named as where the logs come from.

    facts are read for the count, the percentiles and the slowest requests: give a written table where they cost much.
    """
    summary = percentiles(facts)
    fmt = lambda c: F.format_string("%.3f", F.col(c))
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    text = lambda *c: "| " + " | ".join(c) + " |"
    marks = lambda n: "|---|" + "---:|" * (n - 1)
    numbered = lambda section, n: F.concat(F.lit(f"{section}-"), F.lpad((n + 3).cast("string"), 2, "0")).alias("part")
    tail_columns = ("req_id", "status", *TAIL_TIMES)
    fixed = [("0-00", TITLE), ("0-01", f"- Input dir: `{source}`")]
    for section, lines in (("1", (SUMMARY_HEAD, text(*SUMMARY_COLUMNS), marks(len(SUMMARY_COLUMNS)))), ("2", (TAIL_HEAD, text(*tail_columns), marks(len(tail_columns)))), ("3", (END_HEAD,))):
        fixed += [(f"{section}-{i:02d}", line) for i, line in enumerate(("", *lines))]
    out = facts.sparkSession.createDataFrame(fixed, "part string, line string")
    count = facts.agg(F.count("*").alias("n")).select(F.lit("0-02"), F.format_string("- Joined requests: `%d`", "n"))
    place = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric"))
    table = summary.select(numbered("1", place), cells("metric", fmt("p50"), fmt("p95"), fmt("p99")))
    ranked = slowest(facts).withColumn("r", F.row_number().over(Window.orderBy(F.desc("lb_tt_ms"), "req_id")))
    tail = ranked.select(numbered("2", F.col("r")), cells(F.format_string("`%s`", "req_id"), F.col("status").cast("string"), *map(fmt, TAIL_TIMES)))
    highest = (("p99_queue", "lb_qw_ms"), ("p99_eval", "go_eval_ms"), ("p99_parse", "go_parse_ms"))
    last = [F.struct(F.lit("3-02").alias("part"), F.format_string("- Dominant bottleneck candidate: `%s`", "bottleneck").alias("line"))]
    last += [F.struct(F.lit(f"3-{i:02d}").alias("part"), F.format_string(f"- p99 {metric}: `%.3f`", column).alias("line")) for i, (column, metric) in enumerate(highest, 3)]
    verdict = bottleneck(summary).select(F.explode(F.array(*last)).alias("l")).select("l.*")
    for part in (count, table, tail, verdict):
        out = out.union(part)
    return out


def write_report(facts: DataFrame, path: str, source: str = "logs") -> None:
    report_lines(facts, source).orderBy("part").coalesce(1).select("line").write.mode("overwrite").text(path)
