"""Column types of stored tables: inference from records, widening, locks."""

from __future__ import annotations

import json
from collections.abc import Iterable

ORDER = ["bigint", "double", "string"]


def kind_of(value) -> str | None:
    """bigint, double, string or array<...> of a record's value; None where it tells nothing."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "bigint"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    if isinstance(value, (list, tuple)):
        kinds = {kind_of(v) for v in value} - {None}
        inner = "double" if not kinds else ORDER[max(ORDER.index(k) if k in ORDER else 2 for k in kinds)]
        return f"array<{inner}>"
    text = str(value).strip()
    for cast, kind in ((int, "bigint"), (float, "double")):
        try:
            cast(text)
            return kind
        except ValueError:
            pass
    return "string"


def widen(a: str | None, b: str | None) -> str:
    """The type that holds both: bigint < double < string; an array beside a number stays, unequal arrays are text."""
    if a is None or b is None or a == b:
        return a or b or "double"
    arrays = [x.startswith("array") for x in (a, b)]
    if all(arrays):
        return "string"
    if any(arrays):
        other = b if arrays[0] else a
        return "string" if other == "string" else (a if arrays[0] else b)
    return ORDER[max(ORDER.index(a) if a in ORDER else 2, ORDER.index(b) if b in ORDER else 2)]


def infer(records: Iterable[dict], known: dict[str, str] | None = None, locks: Iterable[str] = ()) -> dict[str, str]:
    """Columns of ``known`` widened by the records; locked ones keep their type."""
    out: dict[str, str | None] = dict(known or {})
    fixed = set(locks)
    for record in records:
        for name, value in record.items():
            if name in fixed:
                continue
            kind = kind_of(value)
            out[name] = (out.get(name) if kind is None else kind if out.get(name) is None else widen(out[name], kind))
    return {name: kind or "double" for name, kind in out.items()}


def flatten(record: dict, prefix: str = "") -> dict:
    out = {}
    for name, value in record.items():
        if isinstance(value, dict):
            out |= flatten(value, f"{prefix}{name}.")
        else:
            out[prefix + name] = value
    return out


def converted(value, kind: str):
    """A record's value as its column's type; null where it doesn't fit."""
    if value is None:
        return None
    try:
        if kind == "bigint":
            return int(value)
        if kind == "double":
            return float(value)
        if kind.startswith("array"):
            items = value if isinstance(value, (list, tuple)) else [value]
            return [converted(v, kind[6:-1]) for v in items]
        return json.dumps(value) if isinstance(value, (list, dict)) else str(value)
    except (TypeError, ValueError):
        return None
