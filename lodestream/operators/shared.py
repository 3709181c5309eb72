"""What several operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session in one process without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage, in the shared folder that the session names in spark.checkpoint.dir."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def epoch_ms(column: str | Column) -> Column:
    """Epoch milliseconds of a timestamp with or without zone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_millis(column.cast("timestamp"))


def with_time(df: DataFrame, timestamp: str, name: str = "_time") -> DataFrame:
    return df.withColumn(name, epoch_ms(timestamp))


#: Rows that a stretch of the time line holds on average, and cells that the line is counted in.
STRETCH_ROWS, CELLS = 200_000, 4096


def stretches(df: DataFrame, time: str, rows: int = STRETCH_ROWS) -> Column:
    """A number for the stretch of the time line in which a row lies: stretches hold about ``rows`` rows, however dense the line is.

    The line is counted in cells (one small table on the driver), and cells are put together; the densest stretch is a cell.
    """
    facts = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(time).alias("n")).first()
    parts = -(-(facts["n"] or 0) // rows)
    if parts <= 1:
        return F.lit(0).cast("long")
    n_cells = int(min(CELLS, 16 * parts))
    width = max(1, -(-(facts["hi"] - facts["lo"] + 1) // n_cells))
    cell = F.floor((F.col(time) - F.lit(facts["lo"])) / F.lit(width)).cast("long")
    counts = {r["c"]: r["n"] for r in df.where(F.col(time).isNotNull()).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    of_cell, stretch, held = [], 0, 0
    for c in range(n_cells + 1):
        if held and held + counts.get(c, 0) > rows:
            stretch, held = stretch + 1, 0
        held += counts.get(c, 0)
        of_cell.append(stretch)
    return F.coalesce(F.get(F.array(*map(F.lit, of_cell)), cell.cast("int")).cast("long"), F.lit(-1).cast("long"))
