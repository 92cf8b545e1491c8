"""JSON quality of a text column: validity, repeated keys, repeated list values."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FINDING = T.StructType().add("path", T.StringType()).add("value", T.StringType())
REPORT_SCHEMA = (
    T.StructType()
    .add("valid", T.BooleanType())
    .add("duplicate_keys", T.ArrayType(T.StringType()))
    .add("duplicate_values", T.ArrayType(_FINDING))
)
_REPORT_ARROW = pa.struct(
    [
        ("valid", pa.bool_()),
        ("duplicate_keys", pa.list_(pa.string())),
        ("duplicate_values", pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))),
    ]
)
_FLAT_OBJECT = r"^\s*\{[^{}\[\]]*\}\s*$"


def _repeated(items: list) -> list:
    """Items that occur more than once, or nothing if they cannot be hashed."""
    seen: dict = {}
    try:
        for item in items:
            seen[item] = seen.get(item, 0) + 1
    except TypeError:
        return []
    return [item for item, count in seen.items() if count > 1]


def _list_findings(document: dict) -> list[dict]:
    """Repeated values of every list that is reached through objects only."""
    found, waiting = [], [iter([("", document)])]
    while waiting:  # one iterator per open object, so that order is kept at any depth
        path, value = next(waiting[-1], (None, None))
        if path is None:
            waiting.pop()
        elif isinstance(value, dict):
            waiting.append(iter([(f"{path}.{key}" if path else key, item) for key, item in value.items()]))
        elif isinstance(value, list):
            found += [{"path": path, "value": str(item)} for item in _repeated(value)]
    return found


def inspect_document(text: str) -> dict:
    """Report on one JSON document; ``valid`` is None if it is nested too deep to tell."""
    repeated_keys: list[str] = []

    def to_dict(pairs: list[tuple]) -> dict:
        repeated_keys.extend(_repeated([key for key, _ in pairs]))
        return dict(pairs)

    try:
        document = json.loads(text, object_pairs_hook=to_dict)
    except RecursionError:
        return {"valid": None, "duplicate_keys": [], "duplicate_values": []}
    except ValueError:
        return {"valid": False, "duplicate_keys": [], "duplicate_values": []}
    findings = _list_findings(document) if isinstance(document, dict) else []
    return {"valid": True, "duplicate_keys": sorted(set(repeated_keys)), "duplicate_values": findings}


@F.arrow_udf(REPORT_SCHEMA)
def _inspect(texts: pa.Array) -> pa.Array:
    reports = [None if text is None else inspect_document(text) for text in texts.to_pylist()]
    return pa.array(reports, type=_REPORT_ARROW)


def json_report(c: Column | str) -> Column:
    """``struct(valid, duplicate_keys, duplicate_values)`` for a text column.

    A flat object that Spark's own parser accepts can hold no finding (that
    parser refuses repeated keys), so such rows never reach Python.
    """
    c = F.col(c) if isinstance(c, str) else c
    is_clean = F.coalesce(c.rlike(_FLAT_OBJECT) & F.try_parse_json(c).isNotNull(), F.lit(False))
    nothing_found = F.struct(
        F.lit(True).alias("valid"),
        F.array().cast("array<string>").alias("duplicate_keys"),
        F.array().cast(T.ArrayType(_FINDING)).alias("duplicate_values"),
    )
    checked = _inspect(F.when(~is_clean, c))
    return F.coalesce(checked, F.when(c.isNotNull(), nothing_found))
