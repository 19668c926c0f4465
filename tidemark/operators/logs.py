"""Events written as log lines of five servers, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.windows import ENTRIES_SQL, log
from tidemark.plans.staging import stage
from tidemark.sources.logs import parse_lines


def log_lines(spark, sf_dir):
    """Every event as a line, in a format that goes round by id; every sixth line is noise."""
    e = log(spark, sf_dir).where("path is not null")
    day = F.date_format("ts", "dd/MM/yyyy:HH:mm:ss +0000")
    request = F.concat(F.lit('"'), "method", F.lit(" "), "path", F.lit(' HTTP/1.1" '), F.col("status").cast("string"))
    combined = F.concat("ip", F.lit(" - - ["), day, F.lit("] "), request)
    kind = F.col("event_id") % 6
    line = (
        F.when(kind == 0, F.concat(combined, F.lit(" 1234 \"-\"")))
        .when(kind == 1, combined)
        .when(kind == 2, F.concat("ip", F.lit(":55 - "), request))
        .when(kind == 3, F.to_json(F.struct(F.col("ip").alias("client_ip"), F.col("method").alias("verb"), F.col("path").alias("uri"), F.col("status").alias("status_code"))))
        .when(kind == 4, F.to_json(F.struct(F.col("ip").alias("ClientIP"), F.col("method").alias("ClientRequestMethod"), F.col("path").alias("ClientRequestURI"), F.col("status").alias("EdgeResponseStatus"))))
        .otherwise("garbage")
    )
    return e.select("event_id", line.alias("value"))


def parsed_logs(spark, sf_dir):
    lines = stage(log_lines(spark, sf_dir), "lines")  # lines come from files
    return parse_lines(lines).select("event_id", "source", "ip", "method", "path", F.col("status").cast("long").alias("status"))


def parsed_log_summary(spark, sf_dir):
    return parsed_logs(spark, sf_dir).groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("ips"))


_KIND = "case event_id % 6 when 0 then 'nginx' when 1 then 'apache' when 2 then 'uvicorn' when 3 then 'json' else 'cloudflare' end"
QUERIES = {
    "parsed_logs": (parsed_logs, f"with {ENTRIES_SQL} select event_id, {_KIND} as source, ip, method, path, status::bigint as status from entries where path is not null and event_id % 6 < 5"),
    "parsed_log_summary": (parsed_log_summary, f"with {ENTRIES_SQL} select {_KIND} as source, status::bigint as status, count(*) as n, count(distinct ip) as ips from entries where path is not null and event_id % 6 < 5 group by 1, 2"),
}
