"""Bounded-hop graph queries on an edge table (src, dst[, cost][, time]).

Each hop is a join of the frontier with the edges; it is written to the shared checkpoint folder, so lineage stays
short and a lost executor costs one hop. Frontiers stay distributed, whatever their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def in_window(edges: DataFrame, time: str | None, t0: int | None, t1: int | None) -> DataFrame:
    """Edges with a time in [t0, t1]; null times are out where either bound is given."""
    if time is None or (t0 is None and t1 is None):
        return edges
    kept = edges.where(F.col(time).isNotNull())
    kept = kept if t0 is None else kept.where(F.col(time) >= t0)
    return kept if t1 is None else kept.where(F.col(time) <= t1)


def neighbors(edges: DataFrame, start: str, max_hops: int, time: str | None = None, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """(node_id, prev_id, hop) of nodes within ``max_hops``, each at its first hop; prev_id is the least of its discoverers."""
    spark = edges.sparkSession
    # Saved once: each hop reads the different edges, not the query behind them.
    e = saved(in_window(edges, time, t0, t1).select("src", "dst").distinct())
    kind = edges.schema["src"].dataType
    seen = spark.createDataFrame([(start,)], "node string").select(F.col("node").cast(kind).alias("node_id"), F.lit(None).cast(kind).alias("prev_id"), F.lit(0).alias("hop"))
    found, frontier = seen, seen
    for hop in range(1, max_hops + 1):
        reached = frontier.select(F.col("node_id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("prev_id"))
        frontier = saved(reached.join(found.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.where("hop > 0")


def path(edges: DataFrame, src: str, dst: str, max_hops: int, cost: str | None = None, time: str | None = None, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """(path_id, node_id, ord, hop) of one best path of at most ``max_hops`` edges, or no row.

    Without costs the shortest path, with them the cheapest; ties go to the lesser path, as a list of nodes. Layers
    hold the best path to a node by number of edges, which keeps the hop bound exact.
    """
    spark = edges.sparkSession
    chosen = in_window(edges, time, t0, t1)
    weight = F.col(cost).cast("double") if cost else F.lit(1.0)
    e = saved(chosen.select("src", "dst", weight.alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    kind = edges.schema["src"].dataType
    layer = spark.createDataFrame([(src,)], "n string").select(F.col("n").cast(kind).alias("node"), F.lit(0.0).alias("d"), F.array(F.col("n").cast(kind)).alias("nodes"))
    best = layer.where(F.col("node") == F.lit(dst).cast(kind)).withColumn("h", F.lit(0))
    for hop in range(1, max_hops + 1):
        step = layer.join(e, layer["node"] == e["src"]).where(~F.array_contains("nodes", F.col("dst")))
        grown = step.select(F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.concat("nodes", F.array("dst")).alias("nodes"))
        least = grown.groupBy("node").agg(F.min(F.struct("d", "nodes")).alias("b")).select("node", "b.d", "b.nodes")
        layer = saved(least)
        arrived = layer.where(F.col("node") == F.lit(dst).cast(kind)).withColumn("h", F.lit(hop))
        best = best.unionByName(arrived)
        if cost is None and not arrived.isEmpty() or layer.isEmpty():
            break
    chosen_path = best.orderBy("d", "h", "nodes").limit(1)
    return chosen_path.select(F.posexplode("nodes").alias("ord", "node_id")).select(F.lit(1).cast("long").alias("path_id"), "node_id", F.col("ord").cast("long").alias("ord"), F.col("ord").cast("long").alias("hop"))
