"""Fields of captured reputation-feed bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.classify import threat_label

# Default text and the patterns of the four feed bodies.
NOT_LISTED = "Not Listed"
SCAN_PATTERN = r"(BLACKLISTED [0-9]+/[0-9]+)"
CATEGORY_PATTERN = r'(Categories":\[".*?\])'
APPEARS_TEXT = "<appears>yes</appears>"
FREQUENCY_PATTERN = r"<frequency>([0-9]+)"
LAST_SEEN_PATTERN = r"<lastseen>([^<]+)</lastseen>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def scan_result(body: Column | str) -> Column:
    return F.coalesce(_found(_col(body), SCAN_PATTERN), F.lit(NOT_LISTED))


def threat_result(answer_ip: Column | str) -> Column:
    return F.coalesce(threat_label(answer_ip), F.lit(NOT_LISTED))


def category_result(body: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("Threat "), _found(_col(body), CATEGORY_PATTERN)), F.lit(NOT_LISTED))


def spam_result(body: Column | str) -> Column:
    """``Listed (Frequency: f, Last Seen: t)``; a part that is missing is left out."""
    body = _col(body)
    frequency = F.concat(F.lit("Frequency: "), _found(body, FREQUENCY_PATTERN))
    last_seen = F.concat(F.lit("Last Seen: "), _found(body, LAST_SEEN_PATTERN))
    listed = F.concat(F.lit("Listed ("), F.concat_ws(", ", frequency, last_seen), F.lit(")"))
    return F.when(body.contains(APPEARS_TEXT), listed).otherwise(NOT_LISTED)
