"""Access-log parsing and rule categorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.classify import rule_category
from wardline.functions.text import url_unquote

# 1-based field position to column name of the access log.
LOG_FIELDS = {
    2: "TimeStamp",
    10: "Client IP",
    11: "Http Method",
    12: "ARL",
    13: "Status Code",
    16: "Content Type",
    17: "Host",
    18: "Cookies",
    19: "Referer",
    20: "User Agent",
    21: "If Modified Since",
    22: "SSL",
    23: "Request Number",
    25: "Client request header size",
    26: "Accept Language",
    31: "Request ID",
    37: "X-Forwarded-For",
    53: "Filtered Forward-IP",
    55: "Client rate limiting configuration",
    56: "Client Request Body Size - POST/PUT requests",
    61: "WAF Info (triggered waf rules)",
    70: "Multi Purpase Name Value",
    71: "Request body inspection details",
    73: "QuickRetry Information",
}
LOG_WIDTH = max(LOG_FIELDS)


def select_log_fields(fields: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 24 wanted columns of a log read as ``_c0``, ``_c1``, ..., unquoted."""
    wanted = [
        url_unquote(F.coalesce(F.col(f"_c{position - 1}"), F.lit(""))).alias(name)
        for position, name in LOG_FIELDS.items()
    ]
    return fields.select(*(keep or []), *wanted)


def split_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines to ``_c0.._c72``; quoted fields stay whole, further fields are ignored."""
    schema = ", ".join(f"_c{i} string" for i in range(LOG_WIDTH))
    others = [c for c in lines.columns if c != line]
    row = F.from_csv(F.col(line), schema, {"sep": " ", "escape": '"'})
    return lines.select(*others, F.inline(F.array(row)))


def parse_access_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines to the 24 wanted columns, other input columns kept."""
    others = [c for c in lines.columns if c != line]
    return select_log_fields(split_log_lines(lines, line), others)


def categorise_rules(rows: DataFrame, rule: str | int) -> DataFrame:
    """Rows whose rule id is known, with its category; others are dropped.

    ``rule`` is a column name or a 0-based position.
    """
    column = rows.columns[rule] if isinstance(rule, int) else rule
    return rows.withColumn("category", rule_category(column)).filter(F.col("category").isNotNull())
