"""A key/value store with time to live, and JSON values as DataFrames."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import schemas


def json_frame(spark: SparkSession, value) -> DataFrame:
    """An array of objects (union of keys), one object (a row), or an array of scalars (column ``value``)."""
    value = json.loads(value) if isinstance(value, str) else value
    records = value if isinstance(value, list) else [value]
    records = [schemas.flatten(r) if isinstance(r, dict) else {"value": r} for r in records]
    kinds = schemas.infer(records)
    rows = [tuple(schemas.converted(r.get(n), k) for n, k in kinds.items()) for r in records]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in kinds.items()) or "value string")


@dataclass
class Entry:
    value: object
    ttl: float | None = None
    reset_on_access: bool = False
    expires: float | None = None


class KeyValueStore:
    def __init__(self, clock=time.monotonic):
        self.clock = clock
        self.entries: dict[str, Entry] = {}

    def put(self, key: str, value, ttl: float | None = None, reset_on_access: bool = False) -> None:
        self.entries[key] = Entry(value, ttl, reset_on_access, None if ttl is None else self.clock() + ttl)

    def get(self, key: str):
        entry = self.entries.get(key)
        if entry is None:
            return None
        if entry.expires is not None and self.clock() >= entry.expires:
            del self.entries[key]
            return None
        if entry.reset_on_access and entry.ttl is not None:
            entry.expires = self.clock() + entry.ttl
        return entry.value

    def drop(self, key: str) -> bool:
        return self.entries.pop(key, None) is not None

    def rename(self, old: str, new: str) -> None:
        self.entries[new] = self.entries.pop(old)

    def sweep(self) -> int:
        gone = [k for k, e in self.entries.items() if e.expires is not None and self.clock() >= e.expires]
        for k in gone:
            del self.entries[k]
        return len(gone)

    def keys(self) -> list[str]:
        self.sweep()
        return sorted(self.entries)

    def frame(self, spark: SparkSession, key: str) -> DataFrame:
        """A value as a source of rows: a DataFrame as it is, JSON as ``json_frame``."""
        value = self.get(key)
        if isinstance(value, DataFrame):
            return value
        if isinstance(value, (list, dict)):
            return json_frame(spark, value)
        if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
            return json_frame(spark, value)
        raise ValueError(f"{key} holds no rows")
