"""Windows over time tables, whose ``_time`` column holds epoch milliseconds.

Operators that need a global order have two forms: by partition keys, a plain window; without them, the time line is
cut into buckets and what crosses a cut is carried by a table with one row for each bucket, so no task sees all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .shared import stretches

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def width_ms(width: str | int) -> int:
    """'5m' as milliseconds."""
    if isinstance(width, int):
        return width
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d)\s*", width, re.I)
    if not m or not int(m[1]):
        raise ValueError(f"not a window width: {width!r}")
    return int(m[1]) * UNITS[m[2].lower()]


def bucket(width: str | int, time: str = "_time") -> Column:
    w = width_ms(width)
    return F.col(time) - F.pmod(F.col(time), F.lit(w))


def by_window(df: DataFrame, width: str | int, *aggregates: Column, time: str = "_time") -> DataFrame:
    """Tumbling windows: ``_time`` is the window's start; empty windows have no row. Partial aggregates, one shuffle."""
    if not aggregates:
        numeric = [f.name for f in df.schema.fields if f.name != time and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal")]
        aggregates = tuple(F.avg(c).alias(f"AVG({c})") for c in numeric)
    return df.groupBy(bucket(width, time).alias("_time")).agg(*aggregates)


#: Aggregates of the dialect that ``rolling`` puts together from two spans of time.
MERGED = "AVG MAX MIN SUM COUNT FIRST LAST STDEV DELTA HEIGHT GRADIENT".split()


def _merged(part: str, b: str, o: str) -> str:
    """SQL of a part over two spans from the parts of the earlier one and of the later one, each null where there are no rows."""
    if part == "count":
        return f"coalesce({b}, 0) + coalesce({o}, 0)"
    if part == "sum":
        return f"coalesce({b} + {o}, {b}, {o})"
    if part in ("min", "max"):
        return f"{'least' if part == 'min' else 'greatest'}({b}, {o})"
    if part == "first":
        return f"CASE WHEN {b} IS NULL THEN {o} WHEN {o} IS NULL OR {b}.o <= {o}.o THEN {b} ELSE {o} END"
    n, apart = f"({b}.n + {o}.n)", f"({o}.mean - {b}.mean)"
    both = f"named_struct('n', {n}, 'mean', {b}.mean + {apart} * {o}.n / {n}, 'm2', {b}.m2 + {o}.m2 + {apart} * {apart} * {b}.n * {o}.n / {n})"
    return f"CASE WHEN {b} IS NULL OR {b}.n = 0 THEN {o} WHEN {o} IS NULL OR {o}.n = 0 THEN {b} ELSE {both} END"


def _part_over(kind: str, a: str, by: str, over: WindowSpec) -> Column:
    if kind == "first":
        return F.min_by(F.struct(F.col(by).alias("o"), F.col(a).alias("v")), F.col(by)).over(over)
    if kind == "moments":
        n = F.count(a).over(over)
        return F.struct(n.alias("n"), F.avg(a).over(over).alias("mean"), (F.var_pop(a).over(over) * n).alias("m2"))
    return getattr(F, kind)(a).over(over)


def _rolling_merged(df: DataFrame, w: int, aggregates: dict[str, tuple[str, str]], time: str, keys: list[str], order: tuple[str, str]) -> DataFrame:
    """Time is cut into cells of ``w``: a window is the end of one cell and the beginning of the next. Both are running aggregates,
    so a row costs the same however many rows its window has, and nothing is subtracted.

    The cell before comes as rows that are moved on by ``w``: what a row needs of it is the nearest moved row after its time.
    """
    arguments: dict[str, str] = {}
    parts: dict[tuple[str, str, str], str] = {}

    def argument(e: str) -> str:
        return arguments.setdefault(e, f"__a{len(arguments)}")

    def part(kind: str, e: str, by: str = "") -> str:
        a = argument(e)
        return parts.setdefault((kind, a, argument(by) if by else ""), f"__p{len(parts)}")

    def value(name: str, e: str) -> str:
        first, last = (lambda: f"{part('first', e, order[0])}.v"), (lambda: f"{part('first', e, order[1])}.v")
        if name in ("COUNT", "SUM", "MIN", "MAX"):
            return part(name.lower(), e)
        if name == "AVG":
            kind = df.select(F.expr(f"avg({e})")).schema[0].dataType
            if kind.typeName() == "decimal":
                return f"cast({part('sum', e)} / nullif({part('count', e)}, 0) AS {kind.simpleString()})"
            return f"{part('sum', f'cast({e} AS DOUBLE)')} / nullif({part('count', e)}, 0)"
        if name == "STDEV":
            m = part("moments", f"cast({e} AS DOUBLE)")
            return f"CASE WHEN {m}.n > 1 THEN sqrt({m}.m2 / ({m}.n - 1)) END"
        if name == "HEIGHT":
            return f"{part('max', e)} - {part('min', e)}"
        if name in ("FIRST", "LAST"):
            return first() if name == "FIRST" else last()
        change = f"({last()} - {first()})"
        return change if name == "DELTA" else f"try_divide(cast({change} AS DOUBLE), cast({part('max', f'`{time}`')} - {part('min', f'`{time}`')} AS DOUBLE))"

    values = {name: value(*call) for name, call in aggregates.items()}
    cell = F.floor(F.col(time) / F.lit(w)).cast("long")
    own = df.withColumns({"__cell": cell, "__moved": F.lit(0), **{a: F.expr(e) for e, a in arguments.items()}})
    cells = Window.partitionBy(*keys, "__cell")
    running = lambda over: {name: _part_over(kind, a, by, over) for (kind, a, by), name in parts.items()}
    ends = own.where(F.col(time).isNotNull()).withColumns(running(cells.orderBy(F.col(time).desc())))
    moved = ends.select(*keys, (F.col(time) + w).alias(time), (F.col("__cell") + 1).alias("__cell"), F.lit(1).alias("__moved"), F.struct(*parts.values()).alias("__before"))
    both = own.unionByName(moved, allowMissingColumns=True)  # arguments are null in moved rows
    both = both.withColumn("__before", F.last("__before", ignorenulls=True).over(cells.orderBy(F.col(time).desc(), "__moved").rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumns(running(cells.orderBy(time))).where("__moved = 0")
    kinds = {f.name: f.dataType for f in both.schema.fields}
    merged = {name: F.expr(_merged(kind, f"`__before`.`{name}`", f"`{name}`")) for (kind, *_), name in parts.items()}
    both = both.withColumns({name: m.cast(kinds[name]) if kinds[name].typeName() == "decimal" else m for name, m in merged.items()})
    return both.withColumns({name: F.expr(text) for name, text in values.items()}).drop("__cell", "__moved", "__before", *arguments.values(), *parts.values())


def rolling(df: DataFrame, width: str | int, aggregates: dict[str, Column | tuple[str, str]], time: str = "_time", partition_by: list[str] | None = None, order: tuple[str, str] | None = None) -> DataFrame:
    """``df`` and, for every row, aggregates over the window of ``width`` that ends with its time (rows of equal time are peers).

    An aggregate is one of MERGED with the SQL of its argument, at a constant cost for each row, or any Column, for which each row's
    window is read. ``order`` is the SQL whose least value is first, and that whose least value is last.
    """
    w = width_ms(width)
    keys = list(partition_by or [])
    pairs = {name: a for name, a in aggregates.items() if isinstance(a, tuple)}
    if pairs:
        df = _rolling_merged(df, w, pairs, time, keys, order or (f"`{time}`", f"-`{time}`"))
    columns = {name: a for name, a in aggregates.items() if name not in pairs}
    if not columns:
        return df
    if keys:
        over = Window.partitionBy(*keys).orderBy(time).rangeBetween(-(w - 1), 0)
        return df.withColumns({name: agg.over(over) for name, agg in columns.items()})
    # A window lies in a row's own stretch of ``w`` and the one before: rows are context of the next stretch too.
    own = F.floor(F.col(time) / F.lit(w)).cast("long")
    spread = df.withColumn("__of", own).withColumn("__in", F.explode(F.array_distinct(F.array(own, own + 1))))
    over = Window.partitionBy("__in").orderBy(time).rangeBetween(-(w - 1), 0)
    made = spread.withColumns({name: agg.over(over) for name, agg in columns.items()})
    return made.where("__in <=> __of").drop("__in", "__of")


def previous(df: DataFrame, column: str, order: list[str], name: str = "previous", partition_by: list[str] | None = None) -> DataFrame:
    """``df`` and the value of ``column`` in the row before, by ``order`` (whose first column is a number)."""
    keys = list(partition_by or [])
    if keys:
        return df.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))
    stretched = df.withColumn("__b", stretches(df, order[0]))
    ends = stretched.groupBy("__b").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("__last"))
    ends = ends.select("__b", F.lag("__last").over(Window.orderBy("__b")).alias("__carried"))
    inside = Window.partitionBy("__b").orderBy(*order)
    joined = stretched.join(ends, "__b")
    value = F.when(F.row_number().over(inside) == 1, F.col("__carried.v")).otherwise(F.lag(column).over(inside))
    return joined.withColumn(name, value).drop("__b", "__carried")


def calculate(df: DataFrame, sensor: str, value: str | Column, time: str = "_time") -> DataFrame:
    """Rows (_time, sensor) to append to a time table: the first value column of a query under a new name."""
    column = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(time).alias("_time"), column.alias(sensor))
