"""Access-log lines of several servers to one entry shape, as column expressions.

The formats are tried in order and the first that fits wins; lines that fit none are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Built from the servers' formats, field by field: host, identity, user, [time], "request", status.
_WORD, _QUOTED_REQUEST, _STATUS = r"(\S+)", r'"([A-Z]+) (\S+)(?: [^"]*)?"', r"(\d{3})\b"
COMBINED = "^" + " ".join([_WORD, r"\S+", r"\S+", r"\[([^\]]*)\]", _QUOTED_REQUEST, _STATUS])
UVICORN = r"([^\s:]\S*):\d+ - " + _QUOTED_REQUEST + " " + _STATUS
#: A time, a level, the logger's name, and an object with these members in this order.
CADDY = r"^(\S+T\S+)\s+([A-Z]+)\s+http\.log\.access\b" + "".join(rf'.*?"{name}":{shape}' for name, shape in (("method", r'"([A-Z]+)"'), ("uri", r'"([^"]*)"'), ("status", r"(\d+)"), ("remote_ip", r'"([^"]*)"')))
FIELDS = ("source", "ip", "method", "path", "status", "at")
_GAP = "\u0001"


def _groups(line: Column, pattern: str, order: str) -> Column:
    """Groups of one match, as an array: one pass of the pattern whatever the number of groups."""
    return F.split(F.regexp_replace(line, f"(?s)^.*?{pattern.removeprefix('^')}.*$", _GAP.join(order.split())), _GAP, -1)


def _any_of(line: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(line, f"$.{n}") for n in names])


def parse(line: Column) -> Column:
    """[source, ip, method, path, status, at] of a line as strings, or null."""
    is_json = line.startswith("{") & F.get_json_object(line, "$").isNotNull()
    edge = is_json & _any_of(line, "EdgeResponseStatus", "ClientIP", "ClientRequestURI").isNotNull()
    return (
        F.when(edge, F.array(F.lit("cloudflare"), _any_of(line, "ClientIP"), F.coalesce(_any_of(line, "ClientRequestMethod"), F.lit("GET")), _any_of(line, "ClientRequestURI"), _any_of(line, "EdgeResponseStatus"), _any_of(line, "EdgeStartTimestamp")))
        .when(is_json, F.array(F.lit("json"), _any_of(line, "ip", "remote_addr", "client_ip"), _any_of(line, "method", "verb"), _any_of(line, "path", "url", "uri"), _any_of(line, "status", "status_code"), _any_of(line, "timestamp", "time", "ts")))
        .when(line.rlike(CADDY), _groups(line, CADDY, "caddy $6 $3 $4 $5 $1"))
        .when(line.rlike(COMBINED + " "), _groups(line, COMBINED, "nginx $1 $3 $4 $5 $2"))
        .when(line.rlike(COMBINED), _groups(line, COMBINED, "apache $1 $3 $4 $5 $2"))
        .when(line.rlike(UVICORN), _groups(line, UVICORN, "uvicorn $1 $2 $3 $4"))
    )


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Entries of all readable lines; other columns stay. Works on batches and on streams."""
    others = [c for c in lines.columns if c != col]
    return lines.withColumn("_entry", parse(F.col(col))).where("_entry is not null").select(*others, *[(F.get("_entry", i).cast("int") if n == "status" else F.get("_entry", i)).alias(n) for i, n in enumerate(FIELDS)])
