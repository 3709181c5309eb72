"""Graphs that are written node by node: two stored tables for each, and transactions that append to them at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Store


@dataclass
class Transaction:
    """What COMMIT appends and ABORT forgets."""

    graph: str | None = None
    nodes: list[tuple[int | None, str, str]] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)


def tables(graph: str) -> tuple[str, str]:
    name = graph.replace("/", ".")
    return f"graphs.{name}.nodes", f"graphs.{name}.edges"


def create(store: Store, graph: str) -> None:
    nodes, edges_ = tables(graph)
    store.create(nodes, {"id": "bigint", "label": "string", "name": "string"}, primary_key=["id"])
    store.create(edges_, {"src": "bigint", "dst": "bigint", "kind": "bigint"})


def edges(store: Store, graph: str) -> DataFrame:
    """(src, dst) by the nodes' keys."""
    nodes, between = (store.read(t) for t in tables(graph))
    a, b = (nodes.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(side)) for side in ("src", "dst"))
    named = between.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"))
    return named.join(a, "src_id").join(b, "dst_id").select("src", "dst")


def commit(store: Store, done: Transaction) -> None:
    """Nodes without a number get the next ones."""
    nodes, between = tables(done.graph or "")
    if done.nodes:
        last = store.read(nodes).agg(F.max("id")).first()[0]
        given = [i for i, *_ in done.nodes if i is not None]
        free = max([-1 if last is None else last, *given]) + 1
        rows = []
        for i, label, name in done.nodes:
            if i is None:
                i, free = free, free + 1
            rows.append((i, label, name))
        store.append(nodes, store.spark.createDataFrame(rows, "id long, label string, name string"))
    if done.edges:
        store.append(between, store.spark.createDataFrame(done.edges, "src long, dst long, kind long"))


def compact(store: Store, graph: str) -> None:
    """Many small files as few, each edge once."""
    for t in tables(graph):
        store.replace(t, store.read(t).distinct())


def status(store: Store, graph: str) -> DataFrame:
    nodes, between = (store.read(t).agg(F.count(F.lit(1)).alias("n")) for t in tables(graph))
    return nodes.select(F.lit(graph).alias("name"), F.col("n").alias("nodes")).join(F.broadcast(between.select(F.col("n").alias("edges"))))
