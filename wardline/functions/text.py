"""Text columns: unquoting, packed lists, column names and value type detection."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the parsed form of a packed evidence list.
EVIDENCE_SCHEMA = "array<struct<heuristic_name: string, category: string, hosts: array<string>>>"

# Type names of the loader, in order of detection.
VALUE_TYPES = ("int", "bigint", "double", "datetime", "date", "time", "text")
INT_LIMIT = 2147483647

SPARK_TYPE = {
    "int": "int",
    "bigint": "bigint",
    "double": "double",
    "datetime": "timestamp",
    "date": "date",
    "time": "string",
    "text": "string",
}

_DAY = r"[0-9]{4}-(?:1[0-2]|0?[1-9])-(?:3[01]|[12][0-9]|0?[1-9])"
_CLOCK = r"(?:2[0-3]|[01]?[0-9]):[0-5]?[0-9]:[0-5]?[0-9]"
_LEAP_CLOCK = r"(?:2[0-3]|[01]?[0-9]):[0-5]?[0-9]:6[01]"
_DAY_AND_CLOCK = rf"^{_DAY}(?:\s+{_CLOCK}(?:\.[0-9]{{1,6}})?)?$"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT = r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_unquote(c: Column | str) -> Column:
    """Decode ``%XX``; ``+`` stays ``+`` and broken escapes stay as they are."""
    c = _col(c)
    kept_plus = F.replace(c, F.lit("+"), F.lit("%2B"))
    decoded = F.try_url_decode(F.regexp_replace(kept_plus, "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(c.contains("%"), decoded).otherwise(c)


def safe_name(name: str) -> str:
    """A column name in lower case with runs of other characters as ``_``."""
    return re.sub(r"\W+", "_", name.lower()).strip("_")


def safe_name_column(c: Column | str) -> Column:
    """The same rule as :func:`safe_name`, for names held in a column."""
    return F.btrim(F.regexp_replace(F.lower(_col(c)), r"\W+", "_"), F.lit("_"))


def heuristic_base_name(c: Column | str, strict: bool = False) -> Column:
    """The part before the first ``;``.

    ``strict`` keeps the quirk that a name without ``;`` loses its last character.
    """
    c = _col(c)
    base = F.split_part(c, F.lit(";"), F.lit(1))
    if not strict:
        return base
    return F.when(c.contains(";"), base).otherwise(F.substring(c, F.lit(1), F.length(c) - 1))


def parse_evidences(c: Column | str) -> Column:
    """A packed list of dictionaries (single or double quotes) to an array of structs.

    ``None``, ``True`` and ``False``, and a ``u`` before a quote, are read as
    such outside quoted text only.
    """
    c = _col(c)
    plain = F.when(c.rlike("None|True|False|u['\"]"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_QUOTED), F.lit(0)), _plain), ""))
    return F.from_json(plain.otherwise(c), EVIDENCE_SCHEMA, {"allowSingleQuotes": "true"})


# Quoted texts with their quotes, what stands between them, and quotes without an end.
_QUOTED = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++|."""


def _plain(piece: Column) -> Column:
    read = F.regexp_replace(piece, r"(?<![0-9A-Za-z_])u$", "")
    for literal, value in (("None", "null"), ("True", "true"), ("False", "false")):
        read = F.regexp_replace(read, rf"\b{literal}\b", value)
    return F.when(piece.rlike(r"^['\"]"), piece).otherwise(read)


def bracket_list(c: Column | str) -> Column:
    """``[a,b]`` to an array; blanks and quotes around each item are trimmed."""
    c = _col(c)
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    return F.transform(F.split(inner, ","), lambda item: F.btrim(item, F.lit(" '\"")))


def in_list_text(values: Iterable[object]) -> str:
    """``('a','b')`` for use in a SQL text."""
    quoted = ",".join("'" + str(value).replace("'", "''") + "'" for value in values)
    return f"({quoted})"


def value_type(c: Column | str) -> Column:
    """Loader type of one text value; see ``VALUE_TYPES``.

    Patterns decide, not casts: a cast would accept forms such as ``1d``.
    """
    c = _col(c)
    number = F.trim(c).try_cast("bigint")
    day = F.substring_index(c, " ", 1).try_cast("date")
    return (
        F.when(c.rlike(_INTEGER), F.when(number.between(-INT_LIMIT, INT_LIMIT), "int").otherwise("bigint"))
        .when(c.rlike(_FLOAT), "double")
        .when(c.rlike(rf"^{_DAY}\s+{_CLOCK}(?:\.[0-9]{{1,6}})?$") & day.isNotNull(), "datetime")
        .when(c.rlike(rf"^{_DAY}$") & day.isNotNull(), "date")
        .when(c.rlike(rf"^{_CLOCK}$|^{_LEAP_CLOCK}$"), "time")
        .when(c.isNotNull(), "text")
    )


def typed_value(c: Column | str, loader_type: str) -> Column:
    """Cast a text value to a loader type; NULL where the value does not fit."""
    c = _col(c)
    if loader_type not in SPARK_TYPE:
        raise ValueError(f"unknown loader type: {loader_type!r}")
    target = SPARK_TYPE[loader_type]
    if target == "string":
        return c
    # Patterns go first: the casts alone would accept forms such as 1d or a bare
    # time of day, and a failing cast costs far more than a pattern.
    if target in ("int", "bigint"):
        number = F.when(c.rlike(_INTEGER), F.trim(c).try_cast("bigint"))
        return number if target == "bigint" else F.when(number.between(-INT_LIMIT, INT_LIMIT), number.cast("int"))
    return F.when(c.rlike(_FLOAT if target == "double" else _DAY_AND_CLOCK), F.trim(c).try_cast(target))
