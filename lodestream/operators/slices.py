"""Interval sets: sources, merge, intersection and union, with labels.

A set is a DataFrame (_start_date, _end_date, labels...), times in epoch milliseconds. Merging needs a global order;
it runs in buckets of the time line with carried values for each bucket (the latest end and the label of the interval
before), so that it scales with the number of intervals.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved

START, END = "_start_date", "_end_date"
#: Intervals that a stretch holds on average.
STRETCH_INTERVALS = 200_000


def stretch_of(*frames: DataFrame) -> int:
    """The length of a stretch: as many intervals as a task may sort, and no shorter than intervals are on average."""
    found = [f.agg(F.min(START).alias("lo"), F.max(START).alias("hi"), F.count(F.lit(1)).alias("n"), F.avg(F.col(END) - F.col(START)).alias("mean")).first() for f in frames]
    found = [r for r in found if r["n"]]
    if not found:
        return 1
    length = max(r["hi"] for r in found) - min(r["lo"] for r in found) + 1
    return int(max(1, length * STRETCH_INTERVALS // sum(r["n"] for r in found), 2 * max(r["mean"] or 0 for r in found)))


def to_ms(x: int | str) -> int:
    """A number as it is, ISO-8601 text as epoch milliseconds (UTC)."""
    if isinstance(x, int):
        return x
    moment = datetime.fromisoformat(x.replace("Z", "+00:00"))
    return round((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def manual(spark: SparkSession, rows: list[tuple], labels: list[str] | None = None) -> DataFrame:
    """Rows (start, end, label...) or with a dict of named labels last."""
    names = list(labels or [])
    n_plain = max([len(r) - 2 for r in rows if not (len(r) > 2 and isinstance(r[-1], dict))], default=0)
    named = [k for r in rows if isinstance(r[-1], dict) for k in r[-1]]
    if not names:
        names = list(dict.fromkeys(named)) or [f"label_{k + 1}" for k in range(n_plain)]
    out = []
    for r in rows:
        if isinstance(r[-1], dict):
            out.append((to_ms(r[0]), to_ms(r[1]), *(r[-1].get(n) for n in names)))
        else:
            out.append((to_ms(r[0]), to_ms(r[1]), *(r[2 + k] if 2 + k < len(r) else None for k in range(len(names)))))
    schema = ", ".join([f"{START} long", f"{END} long", *(f"`{n}` string" for n in names)])
    return spark.createDataFrame(out, schema).where(F.col(END) >= F.col(START))


def from_table(df: DataFrame, start: str = START, end: str = END, where: str | Column | None = None, labels: dict[str, Column] | None = None) -> DataFrame:
    kept = df.where(where) if where is not None else df
    columns = [v.cast("string").alias(k) for k, v in (labels or {}).items()]
    return kept.select(F.col(start).cast("long").alias(START), F.col(end).cast("long").alias(END), *columns).where(F.col(START).isNotNull() & (F.col(END) >= F.col(START)))


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (START, END)]


def _islands(df: DataFrame, labels: list[str], by_label: bool, stretch: int) -> DataFrame:
    """``df`` with __island: a number that grows where an interval begins past all ends before it (or its labels differ from the interval before)."""
    order = [START, END, *labels]
    placed = df.withColumn("__b", F.floor(F.col(START) / F.lit(stretch)).cast("long"))
    inside = Window.partitionBy("__b").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    label = F.struct(*labels) if labels else F.lit(1)
    # First what each stretch carries on to the next.
    ends = placed.groupBy("__b").agg(F.max(END).alias("__m"), F.max_by(label, F.struct(*order)).alias("__l"))
    line = Window.orderBy("__b")
    carried = ends.select("__b", F.max("__m").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__cm"), F.lag("__l").over(line).alias("__cl"))
    joined = placed.join(carried, "__b")
    if by_label and labels:
        # Runs of one label in sorted order: the end to reach is that of the run.
        before = F.when(F.row_number().over(inside) == 1, F.col("__cl")).otherwise(F.lag(label).over(inside))
        joined = joined.withColumn("__differs", (~label.eqNullSafe(before)).cast("int"))
    reach = F.greatest(F.max(END).over(earlier), F.col("__cm"))
    new = (reach.isNull() | (F.col(START) > reach)).cast("int")
    if by_label and labels:
        new = F.greatest(new, F.col("__differs"))
    flagged = joined.withColumn("__new", new)
    sums = flagged.groupBy("__b").agg(F.sum("__new").alias("__s"))
    sums = sums.select("__b", F.coalesce(F.sum("__s").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__cs"))
    numbered = flagged.join(sums, "__b")
    return numbered.withColumn("__island", F.col("__cs") + F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))


def merge(df: DataFrame, stretch: int | None = None) -> DataFrame:
    """Overlapping and touching intervals as one; with labels only neighbours of equal labels merge."""
    labels = label_columns(df)
    made = _islands(df, labels, True, stretch or stretch_of(df))
    out = made.groupBy("__island").agg(F.min(START).alias(START), F.max(END).alias(END), *(F.first(c).alias(c) for c in labels))
    return out.select(START, END, *labels)


def _aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    names = list(dict.fromkeys([*label_columns(a), *label_columns(b)]))
    fill = lambda d: d.select(START, END, *(F.col(n) if n in d.columns else F.lit(None).cast("string").alias(n) for n in names))
    return fill(a), fill(b), names


def intersect(a: DataFrame, b: DataFrame, stretch: int | None = None) -> DataFrame:
    """Pairwise overlaps (zero length stays), merged; labels of the right side win where they aren't empty.

    A range join on stretches of the time line: both sides are dealt to each stretch that they touch, and a pair counts
    in the stretch in which its overlap begins.
    """
    a, b = saved(a), saved(b)  # each is read several times
    a, b, names = _aligned(a, b)
    stretch = stretch or stretch_of(a, b)
    deal = lambda d: d.withColumn("__b", F.explode(F.sequence(F.floor(F.col(START) / F.lit(stretch)), F.floor(F.col(END) / F.lit(stretch)))))
    l, r = deal(a).alias("l"), deal(b).alias("r")
    start, end = F.greatest(f"l.{START}", f"r.{START}"), F.least(f"l.{END}", f"r.{END}")
    pairs = l.join(r, (F.col("l.__b") == F.col("r.__b")) & (start <= end)).where(F.floor(start / F.lit(stretch)) == F.col("l.__b"))
    chosen = [F.coalesce(F.nullif(F.col(f"r.`{n}`"), F.lit("")), F.col(f"l.`{n}`")).alias(n) for n in names]
    return merge(saved(pairs.select(start.alias(START), end.alias(END), *chosen)), stretch)


def union(a: DataFrame, b: DataFrame, stretch: int | None = None) -> DataFrame:
    """Both, merged whatever the labels; the earliest label that isn't empty wins, the left side's before the right's."""
    a, b, names = _aligned(a, b)
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))
    both = saved(both)
    if not names:
        return merge(both.drop("__side"), stretch)
    made = _islands(both, ["__side", *names], False, stretch or stretch_of(both))
    order = F.struct("__side", START, END)
    first = [F.min_by(F.nullif(F.col(f"`{n}`"), F.lit("")), F.when(F.nullif(F.col(f"`{n}`"), F.lit("")).isNotNull(), order)).alias(n) for n in names]
    return made.groupBy("__island").agg(F.min(START).alias(START), F.max(END).alias(END), *first).select(START, END, *names)


def by_slice(df: DataFrame, slices: DataFrame, *aggregates: Column, time: str = "_time", stretch: int | None = None) -> DataFrame:
    """Aggregates of the rows in each half-open interval [start, end); empty intervals keep a row; ``_time`` is the start."""
    slices = saved(slices)
    # Rows are many: a stretch holds so many of them, and an interval is dealt to each stretch that it touches.
    stretch = stretch or stretch_of(df.where(F.col(time).isNotNull()).select(F.col(time).alias(START), F.col(time).alias(END)))
    labels = label_columns(slices)
    each = slices.select(START, END, *labels).withColumn("__slice", F.struct(START, END, *labels))
    dealt = each.withColumn("__b", F.explode(F.sequence(F.floor(F.col(START) / F.lit(stretch)), F.floor(F.col(END) / F.lit(stretch)))))
    rows = df.withColumn("__rb", F.floor(F.col(time) / F.lit(stretch))).withColumn("__hit", F.lit(1))
    inside = dealt.join(rows, (F.col("__b") == F.col("__rb")) & (F.col(time) >= F.col(START)) & (F.col(time) < F.col(END)))
    found = inside.groupBy("__slice").agg(*aggregates)
    names = [c for c in found.columns if c != "__slice"]
    empty = rows.limit(0).agg(*aggregates).select(*(F.col(f"`{n}`").alias(f"__e{k}") for k, n in enumerate(names)))
    # What aggregates give over no rows (0 for a count) is one row, and small for certain.
    joined = each.distinct().join(found.withColumn("__present", F.lit(1)), "__slice", "left").join(F.broadcast(empty))
    values = [F.when(F.col("__present").isNull(), F.col(f"__e{k}")).otherwise(F.col(f"`{n}`")).alias(n) for k, n in enumerate(names)]
    return joined.select(F.col(START).alias("_time"), *labels, *values)
