"""Vector distances, exact top-k, and index metadata over tables with a vector column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def as_vector(column: str | Column, kind: str | None = None) -> Column:
    """ARRAY<DOUBLE> of an array, or of text such as '[1,2]', '1, 2' or '(1 2)' (kind 'string')."""
    c = F.col(column) if isinstance(column, str) else column
    if kind == "string":
        parts = F.filter(F.split(F.regexp_replace(c, r"[\[\]()]", " "), r"[\s,]+"), lambda x: x != "")
        return F.transform(parts, lambda x: x.try_cast("double"))
    return c.cast("array<double>")


def of(df: DataFrame, column: str) -> Column:
    return as_vector(column, "string" if df.schema[column].dataType.typeName() == "string" else None)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def score(metric: str, a: Column, b: Column) -> Column:
    """Vectors of unequal length are cut to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    return {"l2": l2, "ip": dot, "cosine": cosine}[metric](a, b)


def literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def nearest(df: DataFrame, column: str, query: list[float], k: int, metric: str = "l2", key: str = "row_id", with_ord: bool = False) -> DataFrame:
    """(row_id, score[, ord]) of the k nearest rows: ascending distance, descending similarity, ties by key.

    A bounded heap in each task and a merge of k rows from each (TakeOrderedAndProject); rows without a vector are out.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    scored = df.select(F.col(key).alias("row_id"), score(metric, of(df, column), literal(query)).alias("score")).where(F.col("score").isNotNull())
    best = scored.orderBy(F.col("score").asc() if metric == "l2" else F.col("score").desc(), F.col("row_id").asc()).limit(k)
    if not with_ord:
        return best
    from pyspark.sql import Window

    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return best.withColumn("ord", F.row_number().over(Window.orderBy(order, "row_id")).cast("long"))  # of k rows


#: Queries of a block, and keys that a block's partial results are dealt out to.
BLOCK_QUERIES, SALTS = 512, 64


def _best_of_batch(metric: str, queries: list[tuple[object, list[float]]], k: int):
    """For Arrow batches (row_id, vector): the k best rows of each batch for every query of the block."""
    import numpy as np
    import pyarrow as pa

    ids, vectors = [q for q, _ in queries], [np.array(v, float) for _, v in queries]

    def run(batches):
        for batch in batches:
            rows = [np.array(v, float) for v in batch.column(1).to_pylist()]
            if not rows:
                continue
            sizes = {len(v) for v in [*rows, *vectors]}
            if len(sizes) == 1:
                a, b = np.stack(vectors), np.stack(rows)
                inner = a @ b.T
                if metric == "l2":
                    # The differences themselves, so that equal vectors have distance 0.
                    scores = np.stack([np.sqrt(((b - x) ** 2).sum(axis=1)) for x in a])
                else:
                    scores = inner if metric == "ip" else inner / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :], 1e-300)
            else:
                scores = np.array([[_plain(metric, x, y) for y in rows] for x in vectors])
            keys = np.array(batch.column(0).to_pylist())
            out = []
            for q, line in zip(ids, scores, strict=True):
                best = np.lexsort((keys, line if metric == "l2" else -line))[:k]
                out += [(q, keys[j].item(), float(line[j])) for j in best]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["query_id", "row_id", "score"])

    return run


def _plain(metric: str, x, y) -> float:
    import numpy as np

    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if metric == "l2":
        return float(np.sqrt(((x - y) ** 2).sum()))
    inner = float(x @ y)
    return inner if metric == "ip" else inner / max(float(np.linalg.norm(x) * np.linalg.norm(y)), 1e-300)


def nearest_many(df: DataFrame, queries: DataFrame, column: str, key: str, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, row_id, score, rank) of the k nearest rows of ``df`` for every row of ``queries``, both with a long ``key``.

    Queries go in blocks of BLOCK_QUERIES: the driver holds one block at a time, every task scores its Arrow batches
    against the block and keeps k rows for each query, and those few meet by query. Rows without a vector are out.
    """
    from pyspark.sql import Window

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    slim = df.select(F.col(key).cast("long").alias("row_id"), of(df, column).alias("v")).where("v IS NOT NULL")
    asked = queries.select(F.col(key).cast("long").alias("q"), of(queries, column).alias("v")).where("v IS NOT NULL")
    best, block = None, []
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()

    def answered(held: list) -> DataFrame:
        return slim.mapInArrow(_best_of_batch(metric, held, k), "query_id long, row_id long, score double")

    for row in asked.toLocalIterator():
        block.append((row["q"], list(row["v"])))
        if len(block) == BLOCK_QUERIES:
            best, block = answered(block) if best is None else best.unionAll(answered(block)), []
    if block or best is None:
        best = answered(block) if best is None else best.unionAll(answered(block))
    # Partial results meet by query in two steps, so that a query's rows from very many tasks don't gather at once.
    salted = best.withColumn("__s", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "__s").orderBy(order, "row_id"))).where(F.col("rank") <= k)
    over = Window.partitionBy("query_id").orderBy(order, "row_id")
    return first.drop("__s").withColumn("rank", F.row_number().over(over).cast("long")).where(F.col("rank") <= k).select("query_id", "row_id", "score", "rank")


@dataclass
class VectorIndex:
    """Metadata of an index. Every engine scans exactly, so recall is 1."""

    name: str
    table: str
    column: str
    metric: str = "l2"
    dim: int | None = None
    mode: str = "REBUILD_ONLY"
    options: dict[str, str] = field(default_factory=dict)
    state: str = "declared"
    rows: int = 0

    def status(self) -> tuple:
        return self.name, self.table, self.column, self.metric, self.dim, self.mode, self.state, self.rows
