"""Exact dedup with a cuckoo-filter index of content digests.

Every digest lives in a shard. A shard's index is a cuckoo filter over 16-bit fingerprints beside the stored keys, which
are bucketed by fingerprint and first slot. A lookup that misses the filter is certain to be new; a hit is verified
against the bucket's full keys; an insertion that overflows doubles the table, refilled from the stored keys. Live
digests can be deleted.

The batch operator first adds up equal digests within salts, so that a text which a third of all rows share comes to
a shard as a few rows; the shards' indexes then merge those. Slim rows move, never texts, and the number of shards
follows the number of rows: an index holds some SHARD_DIGESTS digests, whatever the table.

Defined results: a null text equals the empty text; a text of any length is read whole; of equal texts the row with the
largest doc_id stays, null counting as the smallest; rows equal in both doc_id and text report the same, and
``deduplicated`` keeps one of them, the first by its other columns; an empty table gives an empty table; other columns
keep their names and values, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column

SLOTS = 4
MAX_KICKS = 200
SALTS = 32
SHARD_DIGESTS = 200_000


class CuckooIndex:
    """A cuckoo filter with values, exact through its stored keys. Keys are digests of 16 bytes or more."""

    def __init__(self, capacity: int = 64):
        self.stored: dict[tuple[int, int], dict[bytes, object]] = {}
        self.size = 0
        self.resizes = 0
        self._allocate(max(4, 1 << (max(1, capacity) * 4 // 3 // SLOTS).bit_length()))

    def _allocate(self, n_buckets: int) -> None:
        self.mask = n_buckets - 1
        self.buckets: list[list[int]] = [[] for _ in range(n_buckets)]

    @staticmethod
    def _split(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[4:12], "little"), (int.from_bytes(key[12:14], "little") or 1)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _maybe(self, place: int, mark: int) -> bool:
        first = place & self.mask
        return mark in self.buckets[first] or mark in self.buckets[self._other(first, mark)]

    def _add_mark(self, place: int, mark: int) -> bool:
        """Whether the fingerprint found a slot, after moving others out of the way where it must."""
        at = place & self.mask
        for k in range(MAX_KICKS):
            for b in (at, self._other(at, mark)):
                if len(self.buckets[b]) < SLOTS:
                    self.buckets[b].append(mark)
                    return True
            at = self._other(at, mark) if k % 2 else at
            turn = (k + mark) % SLOTS
            self.buckets[at][turn], mark = mark, self.buckets[at][turn]
            at = self._other(at, mark)
        return False

    def _resize(self) -> None:
        self.resizes += 1
        n = 2 * (self.mask + 1)
        while True:
            self._allocate(n)
            if all(self._add_mark(*self._split(key)) for cell in self.stored.values() for key in cell):
                return
            n *= 2

    def _cell(self, place: int, mark: int) -> tuple[int, int]:
        return mark, place & 0xFFFF

    def get(self, key: bytes, default=None):
        place, mark = self._split(key)
        if not self._maybe(place, mark):
            return default
        return self.stored.get(self._cell(place, mark), {}).get(key, default)

    def __contains__(self, key: bytes) -> bool:
        return self.get(key, self) is not self

    def put(self, key: bytes, value) -> None:
        place, mark = self._split(key)
        cell = self._cell(place, mark)
        if self._maybe(place, mark) and key in self.stored.get(cell, ()):
            self.stored[cell][key] = value
            return
        self.stored.setdefault(cell, {})[key] = value
        self.size += 1
        if not self._add_mark(place, mark):
            self._resize()

    def delete(self, key: bytes) -> bool:
        """Take a live key out; False where it isn't in the index (nothing changes then)."""
        place, mark = self._split(key)
        if key not in self:
            return False
        cell = self._cell(place, mark)
        del self.stored[cell][key]
        if not self.stored[cell]:
            del self.stored[cell]
        first = place & self.mask
        for b in (first, self._other(first, mark)):
            if mark in self.buckets[b]:
                self.buckets[b].remove(mark)
                break
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for cell in self.stored.values():
            yield from cell.items()


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: each partial (digest, greatest id, rows, live) enters the index; what isn't live leaves it."""
    index = CuckooIndex()
    for batch in batches:
        for key, best, rows, live in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not live:
                index.delete(key)
                continue
            had = index.get(key)
            if had is not None:
                ids = [x for x in (best, had[0]) if x is not None]
                best, rows = max(ids, default=None), rows + had[1]
            index.put(key, (best, rows))
    block: list[tuple] = []
    for key, (best, rows) in index.items():
        block.append((key, best, rows))
        if len(block) == 20_000:
            yield _batch(block)
            block = []
    if block:
        yield _batch(block)


def _batch(block: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*block, strict=True), kinds, strict=True)], names=["__digest", "keep_id", "group_size"])


def _sharded(partial: DataFrame, n_rows: int) -> DataFrame:
    """(__digest, keep_id, group_size) of rows (__digest, __best, __rows, __live), through the shards' indexes; deletions come after insertions."""
    least = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partial.select("__digest", "__best", "__rows", "__live").repartition(max(least, -(-n_rows // SHARD_DIGESTS)), "__digest")
    return dealt.sortWithinPartitions(F.desc("__live")).mapInArrow(_merged, "__digest binary, keep_id long, group_size long")


def groups(slim: DataFrame) -> DataFrame:
    """The index of rows (__id, __digest): (__digest, keep_id, group_size)."""
    salted = slim.groupBy("__digest", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).alias("__salt"))
    partial = salted.agg(F.max("__id").alias("__best"), F.count(F.lit(1)).alias("__rows"), F.lit(True).alias("__live"))
    return _sharded(partial, slim.count())


def without(index: DataFrame, gone: DataFrame) -> DataFrame:
    """An index table (__digest, keep_id, group_size) after the deletion of the digests in ``gone`` (__digest); others there change nothing."""
    live = index.select("__digest", F.col("keep_id").alias("__best"), F.col("group_size").alias("__rows"), F.lit(True).alias("__live"))
    dead = gone.select("__digest", F.lit(None).cast("long").alias("__best"), F.lit(0).cast("long").alias("__rows"), F.lit(False).alias("__live")).distinct()
    return _sharded(live.unionAll(dead), index.count())


def _digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(column(doc_id).cast("long").alias("__id"), digest(column(text)).alias("__digest"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = _digests(docs, doc_id, text)
    return slim.join(groups(slim), "__digest").select(
        F.col("__id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each different text, its columns as they are."""
    live = groups(_digests(docs, doc_id, text)).select("__digest", "keep_id")
    # A row travels as one struct, so that its columns can't clash with these.
    row = F.struct(*[column(c).alias(c) for c in docs.columns])
    marked = docs.select(row.alias("__row"), column(doc_id).cast("long").alias("__id"), digest(column(text)).alias("__digest"))
    kept = marked.join(live, "__digest").where(F.col("__id").eqNullSafe(F.col("keep_id")))
    # Rows equal in id and text are left.
    others = [F.col("__row").getField(c).cast("string") for c in docs.columns if c != text]
    first = F.row_number().over(Window.partitionBy("__digest").orderBy(*others))
    return kept.withColumn("__first", first).where("__first = 1").select("__row.*")
