"""Relational operators whose semantics go beyond one DataFrame call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import STRETCH_ROWS, saved

#: Groups up to which their offsets are broadcast.
BROADCAST_GROUPS = 50_000


def union_by_name(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of all frames under the union of their columns; missing ones are null, and types follow the first occurrence."""
    kinds: dict[str, object] = {}
    for f in frames:
        for c in f.schema.fields:
            if c.name not in kinds or kinds[c.name].typeName() == "void":
                kinds[c.name] = c.dataType
    out = None
    for f in frames:
        cast = f.select(*[F.col(f"`{n}`").cast(t).alias(n) if n in f.columns else F.lit(None).cast(t).alias(n) for n, t in kinds.items()])
        out = cast if out is None else out.unionAll(cast)
    return out.distinct() if distinct else out


def numbered_globally(df: DataFrame, order: list[str], name: str, partition: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` (of it the columns ``keep``) and each row's number by SQL sort keys ("x DESC NULLS LAST"), with no task that sees all rows.

    Rows are dealt out by ranges of the keys and sorted there; the sizes of the parts, a row for each, give the offsets.
    Numbers within ``partition`` (SQL) start anew in each group. Groups of up to STRETCH_ROWS rows are plain windows; where
    one is larger, ranges cut through groups, and what a group has in a part, a row for each, gives the offsets.
    """
    keys = []
    for k in order:
        expression, direction, *_ = k.rsplit(" ", 3)
        keys.append(F.expr(expression).desc_nulls_last() if direction == "DESC" else F.expr(expression).asc_nulls_last())
    kept = df.columns if keep is None else keep
    groups = [f"__g{i}" for i in range(len(partition or []))]
    if groups:
        df = df.withColumns({g: F.expr(e) for g, e in zip(groups, partition, strict=True)})
        facts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("groups")).first()
        if (facts["largest"] or 0) <= STRETCH_ROWS:
            return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*(keys or [F.lit(1)]))).cast("long")).select(*[f"`{c}`" for c in kept], name)
        if not keys:
            df, keys = df.withColumn("__any", F.monotonically_increasing_id()), [F.col("__any").asc()]
    keys = [*[F.col(g).asc() for g in groups], *keys]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    # Written down, as the ranges of another run could be others.
    ranged = saved(ranged.select(*[f"`{c}`" for c in kept], *groups, F.monotonically_increasing_id().alias("__i")))
    part, place = F.shiftright("__i", 33), F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    if groups:
        held = ranged.groupBy(part.alias("__p"), *[F.col(g).alias(f"{g}_") for g in groups]).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__start"))
        earlier = Window.partitionBy(*[f"{g}_" for g in groups]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        held = F.broadcast(held) if facts["groups"] <= BROADCAST_GROUPS else held
        same = part == F.col("__p")
        for g in groups:
            same &= F.col(g).eqNullSafe(F.col(f"{g}_"))
        return ranged.join(held, same).withColumn(name, F.col("__before") + place - F.col("__start") + 1).select(*[f"`{c}`" for c in kept], name)
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "__p long, __before long"))
    return ranged.join(before, part == F.col("__p")).withColumn(name, F.col("__before") + place + 1).drop("__i", "__p", "__before")


def any_of(df: DataFrame, column: str, op: str, values: DataFrame, value: str) -> DataFrame:
    """Rows for which ``column op v`` holds for some v. Inequalities need only the extreme v."""
    return _quantified(df, column, op, values, value, some=True)


def all_of(df: DataFrame, column: str, op: str, values: DataFrame, value: str) -> DataFrame:
    """Rows for which ``column op v`` holds for every v; all rows where there is no v, none where one is null."""
    return _quantified(df, column, op, values, value, some=False)


def _quantified(df: DataFrame, column: str, op: str, values: DataFrame, value: str, some: bool) -> DataFrame:
    v = values.select(F.col(value).alias("__v"))
    if op in ("=", "<>") and some == (op == "="):
        inside = df.join(v.where("__v IS NOT NULL").distinct(), df[column] == F.col("__v"), "left_semi")
        if some:
            return inside
    facts = v.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"), F.count("__v").alias("__m"))
    both = df.join(F.broadcast(facts))  # one row
    c, lo, hi = F.col(column), F.col("__lo"), F.col("__hi")
    if some:
        rule = {"<": c < hi, "<=": c <= hi, ">": c > lo, ">=": c >= lo, "<>": (c != lo) | (c != hi)}[op]
        kept = both.where(rule)
    else:
        if op == "<>":
            out = df.join(v.where("__v IS NOT NULL").distinct(), df[column] == F.col("__v"), "left_anti")
            both = out.join(F.broadcast(facts))
            rule = c.isNotNull()
        else:
            rule = {"<": c < lo, "<=": c <= lo, ">": c > hi, ">=": c >= hi, "=": (c == lo) & (c == hi)}[op]
        kept = both.where((F.col("__n") == 0) | ((F.col("__n") == F.col("__m")) & rule))
    return kept.select(*df.columns)
