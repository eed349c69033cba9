"""Nested JSON values: the leaves that say something, and deep merge of two versions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Strings that say nothing.
EMPTY = ("", "—", "-", "{}", "[]", "null")


def parsed(text: str | None) -> Any:
    """The value of a JSON text; a text that isn't JSON is a string."""
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return text


def meaningful(value: Any) -> bool:
    """Whether a value says something: a number or a truth value does, a string unless it is one of EMPTY, an array or object if anything in it does."""
    if isinstance(value, str):
        return value.strip() not in EMPTY
    if isinstance(value, dict):
        return any(map(meaningful, value.values()))
    return any(map(meaningful, value)) if isinstance(value, list) else value is not None


def leaves(value: Any) -> int:
    """How many strings, numbers and truth values in it say something."""
    if isinstance(value, dict):
        return sum(map(leaves, value.values()))
    return sum(map(leaves, value)) if isinstance(value, list) else int(meaningful(value))


def merged(new: Any, old: Any) -> Any:
    """new where it says something, old elsewhere and null where neither does: objects key by key, arrays as wholes."""
    if not meaningful(new):
        return old if meaningful(old) else None
    if isinstance(new, dict) and isinstance(old, dict):
        return old | {k: merged(v, old.get(k)) for k, v in new.items()}
    return new


def _with(df: DataFrame, name: str, kind, of: pa.DataType, value, *columns: str) -> DataFrame:
    """df with a column computed from columns, row by row and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [value(*row) for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, of)], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, kind)]))


def leaf_count(df: DataFrame, column: str, name: str = "leaf_count") -> DataFrame:
    """df with the number of leaves of a JSON column that say something; a null has none."""
    return _with(df, name, LongType(), pa.int64(), lambda x: leaves(parsed(x)), column)


def deep_merge(df: DataFrame, new: str, old: str, name: str = "merged") -> DataFrame:
    """df with the deep merge of two JSON columns as JSON with sorted keys; null where neither says anything."""

    def value(x: str | None, y: str | None) -> str | None:
        out = merged(parsed(x), parsed(y))
        return None if out is None else json.dumps(out, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return _with(df, name, StringType(), pa.string(), value, new, old)
