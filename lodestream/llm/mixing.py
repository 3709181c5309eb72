"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash, so that a block is a random part of its source. A pass over a source
is a permutation of its blocks; the target fixes the source's quota: how many blocks of each pass the mix takes. A
binary tree deals the quotas out to the output shards: at every node, the left half of the shards gets a multivariate-
hypergeometric draw of the node's quotas. A leaf's quotas are what its shard draws: consecutive runs of each source's
permuted blocks, disjoint from those of other shards. The block in which a source's target ends is drawn in part, up to
a threshold on a second hash. A shard orders its documents by a hash: a shuffle within the shard.

The driver holds a row for each source, at most MAX_SOURCES (weights are configuration; more raise an error), and at most
MAX_BLOCKS blocks besides; documents stay in their rows and meet their block by a broadcast of that bounded table. A
shard has some SHARD_BLOCKS blocks, so the number of shards is bounded too, and no larger than the blocks allow.

Defined results: a null text has size 0; a text of any length is counted whole; a null source comes last; rows equal in
doc_id and text share their fate; with nothing to take, nothing is taken; an empty table gives an empty table; other
columns keep their names and values, whatever they are called. Every draw is seeded: reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, column

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (3.0, 1.0, 2.0)
SHARE = 1.5
CEILING = 2.0
SEED = 20240607
MAX_BLOCKS = 1 << 17
MAX_SOURCES = 100_000
BLOCK_DOCS = 64
SHARD_BLOCKS = 8
#: Quotas (shards times sources) that the driver holds.
MAX_LEAVES = 1 << 25


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, ceiling: float = CEILING) -> np.ndarray:
    """``share`` of all sizes by weight, none above ``ceiling`` times its size; the excess is shared again by weight."""
    total, caps = share * float(sizes.sum()), ceiling * sizes.astype(float)
    out, open_ = np.zeros(len(sizes)), sizes > 0
    while open_.any():
        left = total - out[~open_].sum()
        level = left * weights / weights[open_].sum()
        over = open_ & (level > caps)
        if not over.any():
            out[open_] = level[open_]
            return out
        out[over] = caps[over]
        open_ &= ~over
    return out


def split(quotas: np.ndarray, n_shards: int, seed: int = SEED) -> np.ndarray:
    """How many blocks of each source every shard gets: shards x sources, columns adding up to ``quotas``."""
    out = np.zeros((n_shards, len(quotas)), np.int64)

    def node(first: int, last: int, left_over: np.ndarray) -> None:
        if last - first == 1:
            out[first] = left_over
            return
        middle = (first + last) // 2
        rng = np.random.Generator(np.random.PCG64([seed, first, last]))
        n = round(int(left_over.sum()) * (middle - first) / (last - first))
        left = rng.multivariate_hypergeometric(left_over, n, method="marginals")
        node(first, middle, left)
        node(middle, last, left_over - left)

    node(0, n_shards, quotas.astype(np.int64))
    return out


@dataclass
class Plan:
    """``sources``: (source, source_size, target, n_blocks). ``quotas``: drawn blocks, shards x sources. ``blocks``: (source, block, pass, shard, edge)."""

    sources: list[tuple]
    quotas: np.ndarray
    blocks: list[tuple]


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("__id"), F.col("__text"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _block(n_blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col("__h"), 8), n_blocks)


def _slim(docs: DataFrame, doc_id: str, text: str, source: str, rows: bool = False) -> DataFrame:
    """__id, __source, __size, __h and __cut of every row, and with ``rows`` the row itself as one struct, so that its columns can't clash with these."""
    row = [F.struct(*[column(c).alias(c) for c in docs.columns]).alias("__row")] if rows else []
    base = docs.select(*row, column(doc_id).alias("__id"), column(text).alias("__text"), column(source).cast("string").alias("__source"))
    kept = ["__row"] if rows else []
    return base.select(*kept, "__id", "__source", size_of(F.col("__text")).alias("__size"), _hash(SEED).alias("__h"), _hash(SEED + 1).alias("__cut"))


def plan(slim: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, ceiling: float = CEILING, weights: dict | None = None, max_blocks: int = MAX_BLOCKS, shard_blocks: int = SHARD_BLOCKS) -> tuple[Plan, DataFrame, DataFrame]:
    """The quotas, and as small tables: sources, and blocks with their passes."""
    spark = slim.sparkSession
    rows = slim.groupBy("__source").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("w")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before they are mixed")
    rows.sort(key=lambda r: (r["__source"] is None, (r["__source"] or "").encode("utf-32-be", "replace")))
    names = [r["__source"] for r in rows]
    sizes = np.array([r["w"] for r in rows], np.int64)
    weight = np.array([weights[n] if weights else cycle[i % len(cycle)] for i, n in enumerate(names)], float)
    wanted = targets(sizes, weight, share, ceiling)
    n_docs = np.array([r["n"] for r in rows], np.int64)
    all_docs = max(1, int(n_docs.sum()))
    n_blocks = np.maximum(1, np.minimum(-(-n_docs // BLOCK_DOCS), max_blocks * n_docs // all_docs))
    source_rows = [(n, int(s), float(t), int(b)) for n, s, t, b in zip(names, sizes, wanted, n_blocks, strict=True)]
    sources = spark.createDataFrame(source_rows, "__source string, __source_size long, __target double, __n long")
    placed = slim.join(F.broadcast(sources), slim["__source"].eqNullSafe(sources["__source"])).select(slim["__source"], "__size", "__cut", _block(F.col("__n")).alias("__block"))
    found = placed.groupBy("__source", "__block").agg(F.sum("__size").alias("w")).collect()
    at = {n: i for i, n in enumerate(names)}
    words = [np.zeros(b, np.int64) for b in n_blocks]
    for r in found:
        words[at[r["__source"]]][r["__block"]] = r["w"]
    drawn: list[list[tuple[int, int, float | None]]] = []  # (pass, block, words left for the cut block) by source
    for i in range(len(names)):
        left, of_source = float(wanted[i]), []
        for turn in range(int(np.ceil(ceiling))):
            order = np.random.Generator(np.random.PCG64([SEED, i, turn])).permutation(len(words[i]))
            if left >= sizes[i] > 0:
                of_source += [(turn, int(b), None) for b in order]
                left -= float(sizes[i])
                continue
            ends = np.cumsum(words[i][order])
            whole = int(np.searchsorted(ends, left, side="right")) if left > 0 else 0
            of_source += [(turn, int(b), None) for b in order[:whole]]
            rest = left - (float(ends[whole - 1]) if whole else 0.0)
            if left > 0 and whole < len(order) and rest > 0:
                of_source.append((turn, int(order[whole]), rest))
            break
        drawn.append(of_source)
    edges = _cuts(placed, names, drawn)
    drawn = [[(turn, b, edges.get((names[i], b)) if rest is not None else None) for turn, b, rest in d if rest is None or (names[i], b) in edges] for i, d in enumerate(drawn)]
    n_drawn = np.array([len(d) for d in drawn], np.int64)
    leaves = split(n_drawn, max(1, min(int(-(-n_drawn.sum() // shard_blocks)), MAX_LEAVES // max(1, len(names)))))
    blocks = []
    for i, of_source in enumerate(drawn):
        # Each shard draws as many of the source's permuted blocks as its leaf says.
        for (turn, b, edge), k in zip(of_source, np.repeat(np.arange(len(leaves)), leaves[:, i]).tolist(), strict=True):
            blocks.append((names[i], b, turn, k, edge))
    made = spark.createDataFrame(blocks, "__source string, __block long, __pass int, __shard int, __edge long")
    return Plan(source_rows, leaves, blocks), sources, made


def _cuts(placed: DataFrame, names: list, drawn: list) -> dict:
    """For each source's cut block the largest second hash that the mix still takes (null: none)."""
    cut = [(names[i], b, rest) for i, d in enumerate(drawn) for _, b, rest in d if rest is not None]
    if not cut:
        return {}
    wanted = placed.sparkSession.createDataFrame(cut, "__s string, __b long, __rest double")
    inside = placed.join(F.broadcast(wanted), placed["__source"].eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    # Rows of one hash go together; a document counts where at least half of it fits.
    each = inside.groupBy("__s", "__b", "__rest", "__cut").agg(F.sum("__size").alias("__w"))
    running = F.sum("__w").over(Window.partitionBy("__s", "__b").orderBy("__cut"))
    fits = each.withColumn("__end", running).where("__end - __w / 2.0 <= __rest")
    return {(r["__s"], r["__b"]): r["edge"] for r in fits.groupBy("__s", "__b").agg(F.max("__cut").alias("edge")).collect()}


def with_draws(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rows: bool = False, **options) -> tuple[DataFrame, Plan]:
    """Of every document __id, __size, __source_size, __target, and __draws: a struct (pass, shard, place) for each time a shard draws it. ``rows``: the row too, as __row."""
    sizes = checkpointed(_slim(docs, doc_id, text, source))
    made, sources, blocks = plan(sizes, **options)
    of_block = blocks.groupBy("__source", "__block").agg(F.collect_list(F.struct("__pass", "__shard", "__edge")).alias("__turns"))
    base = _slim(docs, doc_id, text, source, True) if rows else sizes
    s, b = sources.alias("s"), of_block.alias("b")
    placed = base.alias("d").join(F.broadcast(s), F.col("d.__source").eqNullSafe(F.col("s.__source"))).select("d.*", "__source_size", "__target", _block(F.col("__n")).alias("__block"))
    found = placed.alias("d").join(F.broadcast(b), F.col("d.__source").eqNullSafe(F.col("b.__source")) & (F.col("d.__block") == F.col("b.__block")), "left").select("d.*", "__turns")
    taken = F.filter(F.coalesce("__turns", F.array()), lambda t: t["__edge"].isNull() | (F.col("__cut") <= t["__edge"]))
    draws = F.transform(taken, lambda t: F.struct(t["__pass"].alias("pass"), t["__shard"].alias("shard"), F.xxhash64(F.lit(SEED + 2), t["__pass"], F.col("__h")).alias("place")))
    return found.select(*["__row"] * rows, "__id", "__size", "__source_size", "__target", draws.alias("__draws")), made


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and the shards that drew it."""
    out, _ = with_draws(docs, doc_id, text, source, **options)
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.size("__draws")).alias("taken"), F.col("__draws.shard").alias("shards"))


def shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix, (__row, shard, place): each shard whole in one partition, in the shuffled order of its places."""
    out, made = with_draws(docs, doc_id, text, source, rows=True, **options)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = out.select("__row", F.explode("__draws").alias("__draw")).select("__row", F.col("__draw.shard").alias("shard"), F.col("__draw.place").alias("place"))
    return each.repartition(max(1, min(len(made.quotas), max(least, len(made.quotas) // 4))), "shard").sortWithinPartitions("shard", "place")


def drawn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself, shard by shard: the rows of ``docs`` as often as they are drawn, their columns as they are."""
    return shards(docs, doc_id, text, source, **options).select("__row.*")
