"""Near-duplicate documents by BagMinHash signatures of word shingles.

A document is the multiset of its shingles of five words. Each shingle has independent Poisson processes over the
dyadic ranges [0, 1), [1, 2), [2, 4), ... of a discretised weight; a point of a process carries a register, a weight
level inside its range and an arrival time, and counts for a document whose weight exceeds the level. The first
arrivals by register are a signature whose registers agree with the probability of the weighted Jaccard similarity. A
process ends once it is past the document's latest register, so that a document costs little more than a point for
each shingle. All documents of a block advance together in numpy.

Signatures are banded. Documents with equal multisets are one node. Two rounds verify multiset overlap:

1. every node meets the most central node of each of its buckets, and verified links merge components;
2. in each bucket that still holds several components, all pairs of nodes of different components are compared. A bucket
   is dealt out in cells of bounded size: its largest component's nodes only meet the others, and a cell counts common
   shingles for all its nodes at once and returns a spanning forest of the links it finds, never the pairs.

So every pair of a bucket at the wanted similarity ends in one class, whatever the bucket's size. What a bucket costs is
the number of nodes outside its largest component times the number of its nodes, as a count in memory; shuffled are
whole cells. Links are verified on the whole multisets, which are made again for candidate nodes only.

Defined results: a text of fewer than five words is one shingle; a text without words (null, empty) is its own class; a
text of any length is read whole; a class is named by its least doc_id; repeated rows are in one class; an empty table
gives an empty table. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, SPACES, checkpointed, column, free_name, mix64, small_batches, texts
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 24
#: Nodes and shingles of one side of a cell.
CELL_NODES, CELL_SHINGLES = 1000, 250_000
#: A hub's partners are dealt out to so many keys.
SALTS = 64
#: Bits for an id, and the most bits, of the bitmap that tells candidate rows apart before they are shuffled (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
BLOCK_BYTES = 4_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(SHINGLE)]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over the bytes."""
    if not raw:
        return np.zeros(0, np.uint64)
    buffer = np.frombuffer(raw, np.uint8)
    space = np.ones(len(buffer) + 2, bool)
    space[1:-1] = _IS_SPACE[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = POWERS.upto(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTES[buffer] * down[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, in order."""
    hashes = word_hashes(raw)
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(hashes))):
        out += hashes[k : k + n] * _POWERS[k % SHINGLE]
    return mix64(out)


def bag(raw: bytes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles and their weights."""
    return np.unique(shingles(raw, size), return_counts=True)


def members(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A set of 64-bit numbers, one for each occurrence, whose intersections are the multisets' intersections."""
    if not len(elements) or weights.max() == 1:
        return elements
    turn = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    each = np.repeat(elements, weights)
    return np.where(turn == 0, each, mix64(each + turn.astype(np.uint64) * _GOLD))


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_owners: int, registers: int = ROWS * BANDS) -> np.ndarray:
    """BagMinHash: first arrival times, owners x registers, of the elements' Poisson processes below their weights."""
    first = np.full(n_owners * registers, np.inf)
    top = int(weights.max()) if len(weights) else 0
    of, low, width = [], [], []
    for j in range(max(1, top - 1).bit_length() + 1 if top else 0):  # the dyadic ranges below the weights
        start = 0 if j == 0 else 1 << (j - 1)
        inside = np.flatnonzero(weights > start)
        of.append(inside)
        low.append(np.full(len(inside), start, float))
        width.append(np.full(len(inside), 1 if j == 0 else start, float))
    if not of:
        return first.reshape(n_owners, registers)
    of, low, width = map(np.concatenate, (of, low, width))
    state = mix64(elements[of] + (low.astype(np.uint64) + np.uint64(1)) * _GOLD)
    time = np.zeros(len(of))
    mine, weight = owner[of], weights[of]
    limit = np.full(n_owners, np.inf)
    while len(state):
        state = mix64(state + _GOLD)
        time = time - np.log1p(-(state >> np.uint64(11)).astype(float) * 2.0**-53) / (width * registers)
        other = mix64(state ^ _GOLD)
        level = low + width * ((other >> np.uint64(32)).astype(float) * 2.0**-32)
        counts = (level < weight) & (time < limit[mine])
        places = mine[counts] * registers + ((other[counts] & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, places, time[counts])
        limit = first.reshape(n_owners, registers).max(axis=1)
        alive = time < limit[mine]
        state, time, low, width, mine, weight = (x[alive] for x in (state, time, low, width, mine, weight))
    return first.reshape(n_owners, registers)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` registers."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, rows)
    keys = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    for k in range(rows):
        keys = mix64(keys ^ bits[:, :, k]) + _GOLD
    return keys.view(np.int64)


def _blocks(raws: list[bytes]) -> Iterator[range]:
    """Runs of texts of about ``BLOCK_BYTES``."""
    start, size = 0, 0
    for k, raw in enumerate(raws):
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield range(start, k + 1)
            start, size = k + 1, 0
    if start < len(raws):
        yield range(start, len(raws))


def _node(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws, ids = texts(batch.column(1)), batch.column(0)
        for block in _blocks(raws):
            bags = [bag(raws[k]) for k in block]
            sizes = [len(e) for e, _ in bags]
            owner = np.repeat(np.arange(len(bags)), sizes)
            made = signatures(np.concatenate([e for e, _ in bags]), np.concatenate([w for _, w in bags]), owner, len(bags))
            keys = band_keys(made)
            nodes = [_node(members(e, w)) if len(e) else None for e, w in bags]
            counts = pa.array([int(w.sum()) for _, w in bags], pa.int64())
            key_lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), keys.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.slice(block.start, len(block)), pa.array(nodes, pa.binary()), counts, key_lists], names=["__id", "__node", "__size", "__keys"])


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(__id, __node, __size, __keys) of every row; __node is null for a text without words."""
    slim = docs.select(column(doc_id).cast("long").alias("__id"), column(text).alias("__text"))
    return slim.mapInArrow(_signed, "__id long, __node binary, __size long, __keys array<long>")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """The bits of hashed ids, as bytes: some sixteen bits for an id, at most MOST_BITS; in rows of 4 KB."""
    n_bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("__id"), F.lit(n_bits)) + 1
    rows = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(n_bits // 8, np.uint8)
    for r in rows:
        piece = np.frombuffer(bytes(r["m"]), np.uint8)
        at = (r["b"] - 1) * len(piece)
        out[at : at + len(piece)] |= piece[: len(out) - at]
    return out


def flagged(docs: DataFrame, ids: DataFrame, columns: list[str], doc_id: str = "doc_id") -> tuple[DataFrame, object]:
    """``columns`` of docs with the place of their id in a bitmap of ``ids`` (__id), and the broadcast bitmap.

    A row outside the bitmap isn't among ``ids``; one inside may be, so an exact join has to follow.
    """
    made = _bitmap(ids)
    spread = docs.sparkSession.sparkContext.broadcast(made)
    place = F.pmod(F.xxhash64(column(doc_id).cast("long")), F.lit(8 * len(made)))
    return docs.select(*[column(c) for c in columns], place.alias("__bit")), spread


def bags_of(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, bag) of the wanted nodes (__node, __id: one row of each), made again from the rows' texts."""
    rows, spread = flagged(docs.select(column(doc_id).alias("__doc"), column(text).alias("__text")), nodes, ["__text"], "__doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = spread.value
        for batch in batches:
            place = batch.column(1).to_numpy()
            hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            found = [members(*bag(raw)) for raw in texts(batch.column(0).take(pa.array(hit)))]
            found = [x for x in found if len(x)]
            for k in range(0, len(found), 500):
                part = found[k : k + 500]
                ends = np.cumsum([0, *map(len, part)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(part).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in part], pa.binary()), lists], names=["node", "bag"])

    made = rows.mapInArrow(run, "node binary, bag array<long>")
    return made.join(nodes.select(F.col("__node").alias("node")), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose multisets overlap enough. A hub ``v`` has a copy of its bag for each of at most SALTS keys."""
    salted = pairs.withColumn("__s", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
    mine = salted.join(bags.select(F.col("node").alias("u"), F.col("bag").alias("__a")), "u")
    hubs = salted.select("v", "__s").distinct().join(bags.select(F.col("node").alias("v"), F.col("bag").alias("__b")), "v")
    common = F.size(F.array_intersect("__a", "__b"))
    return mine.join(hubs, ["v", "__s"]).where(common >= F.lit(similarity) * (F.size("__a") + F.size("__b") - common)).select("u", "v")


def _star(rooted: DataFrame) -> DataFrame:
    """Pairs (u, v) of every node with the most central node of each of its buckets."""
    first = rooted.groupBy("key").agg(F.min_by("node", F.struct(-F.col("score"), F.col("node"))).alias("v"))
    return rooted.join(first, "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def cells(rooted: DataFrame, nodes_of: int | None = None, shingles_of: int | None = None, node: str = "node", least: int = 3) -> DataFrame:
    """The rows of buckets (key) of ``least`` nodes or more that hold several components (root), and the cells they are dealt out to.

    Of two nodes of different components some cell holds both. Buckets of the same members count once.
    """
    nodes_of, shingles_of = nodes_of or CELL_NODES, shingles_of or CELL_SHINGLES
    parts = rooted.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64(node)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), node)).alias("y")
    )
    whole = parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("main"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
    )
    open_ = whole.where((F.col("roots") > 1) & (F.col("n") >= least)).groupBy("n", "x", "y", "roots").agg(F.min_by(F.struct("key", "size", "main"), "key").alias("b")).select("n", "b.*")
    side = lambda n, size: F.greatest(F.lit(1), F.ceil(n / nodes_of), F.ceil(size / shingles_of))
    sized = open_.select(
        "key", F.col("main.root").alias("main"), side(F.col("main.n"), F.col("main.size")).alias("of_main"), side(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("of_rest")
    )
    held = rooted.join(sized, "key").withColumn("in_main", F.col("root") == F.col("main"))
    chunk = F.pmod(F.xxhash64(F.lit(2), node), F.when(F.col("in_main"), F.col("of_main")).otherwise(F.col("of_rest")))
    rest, main = (F.sequence(F.lit(0).cast("long"), F.col(n) - 1) for n in ("of_rest", "of_main"))
    base = F.col("of_rest") * F.col("of_rest")
    with_rest = F.transform(rest, lambda x: F.least(x, chunk) * F.col("of_rest") + F.greatest(x, chunk))
    with_main = F.transform(main, lambda y: base + chunk * F.col("of_main") + y)
    of_main = F.transform(rest, lambda x: base + x * F.col("of_main") + chunk)
    single = F.col("of_rest") + F.col("of_main") == 2
    made = F.when(single, F.array(F.lit(0).cast("long"))).when(F.col("in_main"), of_main).otherwise(F.concat(with_rest, with_main))
    return held.select(*rooted.columns, F.explode(made).alias("cell"))


def common_counts(elements: np.ndarray, owner: np.ndarray, n: int, rows: np.ndarray | None = None) -> np.ndarray:
    """How many elements each of the sets ``rows`` (all by default) shares with each of ``n`` sets; with itself, any number."""
    rows = np.arange(n) if rows is None else rows
    line = np.full(n, -1)
    line[rows] = np.arange(len(rows))
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    edges = np.flatnonzero(np.concatenate(([True], elements[1:] != elements[:-1]))) if len(elements) else np.zeros(0, np.int64)
    df = np.diff(np.concatenate((edges, [len(elements)])))
    wanted = np.add.reduceat(line[owner] >= 0, edges) > 0 if len(edges) else np.zeros(0, bool)
    places = [np.zeros(0, np.int64)]
    for d in range(2, 5):  # what few sets share adds to each of their pairs
        of = owner[edges[(df == d) & wanted][:, None] + np.arange(d)]
        for a in range(d):
            for b in range(d):
                if a != b:
                    held = line[of[:, a]] >= 0
                    places.append(line[of[held, a]] * n + of[held, b])
    out = np.bincount(np.concatenate(places), minlength=len(rows) * n).reshape(len(rows), n).astype(np.float32)
    many = np.flatnonzero((df > 4) & wanted)
    step = max(1, 16_000_000 // max(1, n))
    for k in range(0, len(many), step):  # what many share is a product of 0/1 matrices
        part = many[k : k + step]
        of = np.repeat(edges[part] - np.concatenate(([0], np.cumsum(df[part])[:-1])), df[part]) + np.arange(df[part].sum())
        dense = np.zeros((n, len(part)), np.float32)
        dense[owner[of], np.repeat(np.arange(len(part)), df[part])] = 1
        out += dense[rows] @ dense.T
    return out


def outside_largest(root: np.ndarray) -> np.ndarray:
    """The members that aren't of the largest component."""
    return np.flatnonzero(root != np.bincount(root).argmax())


def forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Of links (a, b) between members those that connect components (root) that no earlier one connects."""
    top = {r: r for r in root.tolist()}

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    # Between two components one link is enough.
    _, first = np.unique(np.stack((root[a], root[b])), axis=1, return_index=True)
    out = []
    for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
        x, y = find(int(root[i])), find(int(root[j]))
        if x != y:
            top[x] = y
            out.append((i, j))
    return out


def by_cell(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``n_keys`` columns, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(n_keys)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            now = tuple(keys[a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _settled(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (u, v) between different components of a cell, from rows (key, cell, node, root, bag) sorted by cell."""
    for cell in by_cell(batches, 2):
        nodes, roots = cell.column("node").to_pylist(), cell.column("root").to_pylist()
        bags = cell.column("bag").combine_chunks()
        sizes = np.diff(bags.offsets.to_numpy())
        n = len(nodes)
        known: dict[bytes, int] = {}
        root = np.array([known.setdefault(r, len(known)) for r in roots])
        rest = outside_largest(root)
        common = common_counts(bags.flatten().to_numpy(), np.repeat(np.arange(n), sizes), n, rest)
        near = (common >= similarity * (sizes[rest, None] + sizes[None, :] - common) - 1e-6) & (root[rest, None] != root[None, :])
        i, j = np.nonzero(near)
        found = forest(rest[i], j, root)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.binary()), pa.array([nodes[j] for _, j in found], pa.binary())], names=["u", "v"])


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the class's least doc_id), class_size."""
    rows = checkpointed(signed(docs, doc_id, text))
    of_node = rows.where("__node IS NOT NULL").groupBy("__node")
    nodes = checkpointed(of_node.agg(F.min("__id").alias("__id"), F.count(F.lit(1)).alias("__n"), F.first("__size").alias("__size"), F.first("__keys").alias("__keys")))
    banded = nodes.select(F.col("__node").alias("node"), F.col("__size").alias("size"), F.explode("__keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    met = banded.join(shared, "key")
    # How many it meets in all its buckets: most for the text that copies of one group descend from.
    central = met.groupBy("node").agg(F.sum("__n").alias("score"))
    buckets = checkpointed(met.drop("__n").join(central, "node"))
    candidates = buckets.select(F.col("node").alias("__node")).distinct().join(nodes.select("__node", "__id"), "__node")
    bags = checkpointed(bags_of(docs, candidates, doc_id, text))
    edges = components(checkpointed(verified(_star(buckets), bags, similarity)), 2).select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    rooted = checkpointed(buckets.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")))
    # The nodes of a bucket of two have met already.
    dealt = cells(rooted).join(bags, "node").select("key", "cell", "node", "root", "bag")
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    with small_batches(docs.sparkSession):
        more = checkpointed(dealt.mapInArrow(lambda batches: _settled(batches, similarity), "u binary, v binary"))
    roots = components(edges.unionAll(more))
    named = nodes.select(F.col("__node").alias("node"), "__id", "__n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("__id").alias("class_id"), F.sum("__n").alias("class_size"))
    of_node = named.join(classes, "root").select(F.col("node").alias("__node"), "class_id", "class_size")
    # Texts without words have nodes of their own, so that null doesn't gather them in one task.
    with_words = rows.where("__node IS NOT NULL").select("__id", "__node").join(of_node, "__node")
    out = with_words.select(F.col("__id").alias("doc_id"), "class_id", "class_size")
    alone = rows.where("__node IS NULL").select(F.col("__id").alias("doc_id"), F.col("__id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionAll(alone)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are the least doc_id of their class, their columns as they are; texts without words and rows without a doc_id all stay."""
    classes = checkpointed(near_groups(docs, doc_id, text, similarity))
    name = free_name(docs, "__gone")
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, column(doc_id).cast("long") == F.col(name), "left_anti")
