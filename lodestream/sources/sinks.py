"""Results as JSON rows and as a table of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One column ``value``: every row as a JSON object, nulls kept; written with ``df.write.text``, or collected by the caller."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def table_text(df: DataFrame, n: int = 50) -> str:
    """The first ``n`` rows with a head line, in columns as wide as their longest value."""
    shown = ["" if v is None else str(v) for row in [df.columns, *df.limit(n).collect()] for v in row]
    lines = [shown[k : k + len(df.columns)] for k in range(0, len(shown), max(1, len(df.columns)))]
    widths = [max(map(len, column)) for column in zip(*lines, strict=True)]
    return "\n".join(" | ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() for line in lines)
