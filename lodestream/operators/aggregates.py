"""The dialect's aggregates as Columns. Positional ones take the order that says what is first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _order(order: str | list[str]) -> Column:
    return F.col(order) if isinstance(order, str) else F.struct(*order)


def first(e: str | Column, order: str | list[str]) -> Column:
    """The value of the first row in ``order``, null values included."""
    return F.min_by(F.struct(_column(e).alias("v")), _order(order))["v"]


def last(e: str | Column, order: str | list[str]) -> Column:
    return F.max_by(F.struct(_column(e).alias("v")), _order(order))["v"]


def delta(e: str | Column, order: str | list[str]) -> Column:
    return last(e, order) - first(e, order)


def height(e: str | Column) -> Column:
    return F.max(_column(e)) - F.min(_column(e))


def gradient(e: str | Column, order: str | list[str], time: str = "_time") -> Column:
    """Change per millisecond; null over no time."""
    return F.try_divide(delta(e, order).cast("double"), (F.max(time) - F.min(time)).cast("double"))


def stdev(e: str | Column) -> Column:
    return F.stddev_samp(_column(e))


def quantile(e: str | Column, percent: int = 50) -> Column:
    """Nearest rank: the sorted values' element at round(q * (n - 1)). For groups of bounded size."""
    values = F.sort_array(F.collect_list(_column(e)))
    return F.get(values, F.floor(F.lit(percent / 100.0) * (F.size(values) - 1) + 0.5).cast("int"))


def array_agg(e: str | Column) -> Column:
    """Values as text, sorted so that results don't hang on row order."""
    return F.sort_array(F.collect_list(_column(e).cast("string")))
