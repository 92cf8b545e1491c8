"""Time tokens in SQL text, and explicit time windows.

Everything here is a pure function of its arguments: ``as_of_ms`` (the current
time in epoch milliseconds) is always passed in, so results are repeatable.
All times are UTC.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

# The lag of the warehouse load, the reach of each counted unit,
# and how many days back a full-day window may lie.
LOAD_OFFSET_MS = 4 * HOUR_MS
RETENTION_DAYS = 30
UNIT_MS = {"hour": HOUR_MS, "day": DAY_MS, "week": 7 * DAY_MS, "month": 14 * DAY_MS}
COUNT_LIMIT = {"hour": 24, "day": 31, "week": 12, "month": 1}

_PHRASE = re.compile(
    r"(?:(?P<count>\d+)\s+)?(?P<unit>hour|day|week|month|minute)s?\s+ago(?P<plus>\s*\+\s*1)?", re.IGNORECASE
)
_RELATIVE = re.compile(r"@(?P<body>now|30_mins_ago|(?:\d+_)?(?:hour|day|week|month)s?_ago)\b")
_DATE = re.compile(r"'?@date:\s*(?P<day>[^\s']+)(?:\s+(?P<clock>\d{1,2}:\d{1,2}))?\s*'?", re.IGNORECASE)
_FULL_DAY = re.compile(r"'?@(?P<table>\w+)\.full_day:\s*(?P<day>yesterday|[0-9./-]+)'?", re.IGNORECASE)

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _utc(ms: int) -> datetime:
    return datetime.fromtimestamp(ms // 1000, tz=timezone.utc)


def _ms(moment: datetime) -> int:
    return int(moment.timestamp()) * 1000


def phrase_offset_ms(phrase: str) -> int:
    """How far back a phrase such as ``2 weeks ago + 1`` reaches, without load lag."""
    text = phrase.strip().lower()
    if text in ("", "now"):
        return 0
    match = _PHRASE.fullmatch(text)
    if not match:
        raise ValueError(f"unknown time phrase: {phrase!r}")
    unit, count = match["unit"], int(match["count"] or 1)
    extra = DAY_MS if match["plus"] else 0
    if unit == "minute":
        if count != 30 or extra:
            raise ValueError(f"unknown time phrase: {phrase!r}")
        return 30 * MINUTE_MS
    if not 1 <= count <= COUNT_LIMIT[unit]:
        raise ValueError(f"{phrase!r} is outside 1..{COUNT_LIMIT[unit]} {unit}s")
    if extra and unit not in ("day", "week"):
        raise ValueError(f"'+ 1' needs days or weeks: {phrase!r}")
    return count * UNIT_MS[unit] + extra


def resolve_phrase(phrase: str, as_of_ms: int, load_offset_ms: int = LOAD_OFFSET_MS) -> int:
    """Epoch milliseconds of a phrase, whole seconds, after the load lag."""
    return as_of_ms // 1000 * 1000 - phrase_offset_ms(phrase) - load_offset_ms


def resolve_token(token: str, as_of_ms: int, load_offset_ms: int = LOAD_OFFSET_MS) -> int:
    """Epoch milliseconds of ``@now``, ``@day_ago``, ``@3_weeks_ago`` and so on."""
    match = _RELATIVE.fullmatch(token.strip())
    if not match:
        raise ValueError(f"unknown time token: {token!r}")
    body = match["body"].replace("30_mins", "30_minutes").replace("_", " ")
    return resolve_phrase(body, as_of_ms, load_offset_ms)


def parse_day(text: str, as_of_ms: int) -> datetime:
    """``d[/m[/y]]`` with ``.``, ``/`` or ``-``; what is missing comes from ``as_of_ms``."""
    now = _utc(as_of_ms)
    parts = re.split(r"[./-]", text.strip())
    if not 1 <= len(parts) <= 3:
        raise ValueError(f"not a date: {text!r}")
    day = int(parts[0])
    month = int(parts[1]) if len(parts) > 1 else now.month
    year = now.year
    if len(parts) > 2:
        year = int(parts[2]) + 2000 if len(parts[2]) == 2 else int(parts[2])
    return datetime(year, month, day, tzinfo=timezone.utc)


def date_token_ms(day: str, clock: str | None, as_of_ms: int) -> int:
    """Epoch milliseconds of a ``@date:`` token; no load lag applies."""
    ms = _ms(parse_day(day, as_of_ms))
    if clock:
        hours, minutes = (int(part) for part in clock.split(":"))
        if not (0 <= hours <= 24 and 0 <= minutes <= 59):
            raise ValueError(f"not a time of day: {clock!r}")
        ms += hours * HOUR_MS + minutes * MINUTE_MS
    return ms


def full_day_window(day: str, as_of_ms: int, retention_days: int | None = RETENTION_DAYS) -> tuple[int, int]:
    """The half-open window of one UTC day; ``yesterday`` is accepted."""
    now = _utc(as_of_ms)
    if day.strip().lower() == "yesterday":
        start = datetime(now.year, now.month, now.day, tzinfo=timezone.utc) - timedelta(days=1)
    else:
        start = parse_day(day, as_of_ms)
        if retention_days is not None and not 0 <= (now - start).days <= retention_days:
            raise ValueError(f"{day!r} is not within the last {retention_days} days")
    return _ms(start), _ms(start) + DAY_MS


def relative_window(
    start: str = "@day_ago", end: str = "@now", *, as_of_ms: int, load_offset_ms: int = LOAD_OFFSET_MS
) -> tuple[int, int]:
    """Half-open window between two tokens; the default is the last day."""
    return resolve_token(start, as_of_ms, load_offset_ms), resolve_token(end, as_of_ms, load_offset_ms)


def _start_moment(text: str, as_of_ms: int) -> datetime:
    now = _utc(as_of_ms)
    word = text.strip().lower().lstrip("@").replace("_", " ").removeprefix("last ").strip()
    today = datetime(now.year, now.month, now.day, tzinfo=timezone.utc)
    if word in ("today", "yesterday"):
        return today - timedelta(days=int(word == "yesterday"))
    if word in WEEKDAYS:
        back = (now.weekday() - WEEKDAYS.index(word)) % 7 or 7
        return today - timedelta(days=back)
    if word.endswith("ago"):
        moment = _utc(as_of_ms - phrase_offset_ms(word))
        return datetime(moment.year, moment.month, moment.day, tzinfo=timezone.utc)
    return parse_day(text, as_of_ms)


def span_window(spec: str, as_of_ms: int) -> tuple[int, int]:
    """``date,time,increment,unit`` to a half-open window, e.g. ``10/10/2016,00:00,1,d``.

    The start is truncated to the hour.  Day names mean the last such day.
    """
    parts = [part.strip() for part in spec.strip("() ").split(",")]
    if len(parts) != 4 or parts[3] not in ("h", "d"):
        raise ValueError(f"expected date,time,increment,h|d but got {spec!r}")
    hours = int(parts[1].split(":")[0])
    if not 0 <= hours <= 23:
        raise ValueError(f"not a time of day: {parts[1]!r}")
    start = _ms(_start_moment(parts[0], as_of_ms)) + hours * HOUR_MS
    return start, start + int(parts[2]) * (HOUR_MS if parts[3] == "h" else DAY_MS)


def render(
    sql: str,
    as_of_ms: int,
    *,
    start_date: str | None = None,
    end_date: str | None = None,
    load_offset_ms: int = LOAD_OFFSET_MS,
    retention_days: int | None = RETENTION_DAYS,
) -> str:
    """Replace every time token in a SQL text; the result goes to ``spark.sql``."""
    for token, phrase in (("@start_date", start_date), ("@end_date", end_date)):
        if token in sql:
            if phrase is None:
                raise ValueError(f"the query uses {token}: pass {token[1:]}=")
            sql = sql.replace(token, str(resolve_phrase(phrase, as_of_ms, load_offset_ms)))

    def full_day(match: re.Match) -> str:
        lo, hi = full_day_window(match["day"], as_of_ms, retention_days)
        table = match["table"]
        return f"{table}.ts >= '{lo}' AND {table}.ts < '{hi}'"

    sql = _DATE.sub(lambda m: f"'{date_token_ms(m['day'], m['clock'], as_of_ms)}'", sql)
    sql = _FULL_DAY.sub(full_day, sql)
    return _RELATIVE.sub(lambda m: str(resolve_token(m[0], as_of_ms, load_offset_ms)), sql)


def in_window(ts: Column | str, window: tuple[int, int], closed: bool = False) -> Column:
    """``lo <= ts < hi`` on an epoch-millisecond column, or ``<= hi`` when closed."""
    c = F.col(ts) if isinstance(ts, str) else ts
    lo, hi = F.lit(window[0]).cast("bigint"), F.lit(window[1]).cast("bigint")
    return (c >= lo) & ((c <= hi) if closed else (c < hi))


def in_days(day: Column | str, window: tuple[int, int]) -> Column:
    """The days a window touches, for tables partitioned by a date column.

    Added to :func:`in_window` it lets Spark skip whole partitions.
    """
    c = F.col(day) if isinstance(day, str) else day
    first, last = (_utc(ms).strftime("%Y-%m-%d") for ms in (window[0], window[1]))
    return c.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def hour_of(ts: Column | str) -> Column:
    """Epoch milliseconds rounded down to the UTC hour."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c - F.pmod(c, F.lit(HOUR_MS).cast("bigint"))
