"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes where a string of 100 bytes around it also starts earlier: in a smaller doc_id, or before in the same
document. Two equal strings of 100 bytes have the same least 50-gram by hash, their anchor, at the same offset. So

1. anchors of all texts (one in about 26 bytes) are dealt out by hash; those that occur once are out;
2. texts with repeated anchors send the runs of bytes around these to the anchor's shard;
3. a shard sorts the suffixes that start in its runs. Prefix polynomial hashes and binary search give two suffixes'
   common extension, hence their order, in a logarithmic number of steps; a bottom-up mergesort runs all its
   comparisons of a level together in numpy. Neighbours that agree over 100 bytes are verified byte by byte; all but
   the earliest of equals are marked;
4. marks come back to their texts as merged spans.

Equal texts enter once. An anchor of very many texts is dealt by the hash of each string around it instead, after
strings that a block of texts repeats within itself are settled there: a string comes to its shard once for each block
of some 4 MB that has it.

Defined results: a null text has 0 bytes; a text under 100 bytes keeps all; a text of any length is read whole; of equal
texts of 100 bytes or more all but the first are removed whole; a null doc_id comes before all others; documents that tie
in doc_id follow their text's hash; an empty table gives an empty table. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import flagged
from .common import POWERS, checkpointed, column, mix64, texts

LENGTH = 100
GRAM = 50
#: Places of an anchor beyond which its strings are settled by block first.
HOT = 4096
BLOCK_BYTES = 4_000_000
SHARD_BYTES = 8_000_000
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
NULL_ID = -(2**63)


class Prefix:
    """Prefix polynomial hashes of a buffer: the hash of any of its substrings takes one product."""

    def __init__(self, buffer: np.ndarray):
        self.buffer = buffer
        self.up, down = POWERS.upto(len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_TABLE[buffer] * down[: len(buffer)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * self.up[starts]

    def grams(self, size: int) -> np.ndarray:
        n = len(self.buffer) - size + 1
        return (self.sums[size:] - self.sums[:n]) * self.up[:n]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """How far the suffixes at ``a`` and ``b`` agree, at most ``limit``: whole, or by binary search on hashes."""
        out = np.full(len(a), limit)
        apart = np.flatnonzero(self.hashes(a, limit) != self.hashes(b, limit))
        a, b = a[apart], b[apart]
        first_a, first_b = self.sums[a], self.sums[b]
        up_a, up_b = self.up[a], self.up[b]
        low = np.zeros(len(a), np.int64)
        step = 1 << (limit.bit_length() - 1)
        while step:
            tried = low + step
            at = np.minimum(tried, limit)
            ok = (tried < limit) & ((self.sums[a + at] - first_a) * up_a == (self.sums[b + at] - first_b) * up_b)
            low[ok] = tried[ok]
            step >>= 1
        out[apart] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, limit: int, or_equal: np.ndarray) -> np.ndarray:
        far = self.common(a, b, limit)
        equal = far == limit
        at = np.minimum(far, limit - 1)
        return np.where(equal, or_equal, self.buffer[a + at] < self.buffer[b + at])


def sort_suffixes(prefix: Prefix, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """A stable order of the suffixes at ``starts`` by their first ``limit`` bytes within each ``group``.

    ``group`` is sorted. Bottom-up mergesort: every suffix finds its rank in the neighbouring run by binary search, all
    suffixes of a level at once.
    """
    n = len(starts)
    order = np.arange(n)
    if not n:
        return order
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((edges, [n])))
    width = 1
    while width < sizes.max():
        wide = sizes > width
        first, size = np.repeat(edges[wide], sizes[wide]), np.repeat(sizes[wide], sizes[wide])
        local = np.arange(len(first)) - np.repeat(np.cumsum(sizes[wide]) - sizes[wide], sizes[wide])
        run = local // width
        low = np.minimum((run ^ 1) * width, size)
        high = np.minimum(low + width, size)
        base, is_right = low.copy(), run % 2 == 1
        mine = starts[order[first + local]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            other = starts[order[first[open_] + middle]]
            before = prefix.less(other, mine[open_], limit, is_right[open_])
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
        target = first + (run // 2) * 2 * width + local % width + (low - base)
        moved = order.copy()
        moved[target] = order[first + local]
        order = moved
        width *= 2
    return order


def repeats(buffer: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Which suffixes agree over ``limit`` bytes with one that comes before them in their group (equal hashes are verified)."""
    prefix = Prefix(buffer)
    out = np.zeros(len(starts), bool)
    # Equal strings of a group have equal hashes: one whose hash no other has is out, and of those that share one the first is sorted for all.
    whole = mix64(prefix.hashes(starts, limit)) ^ mix64(group.astype(np.uint64))
    line = np.argsort(whole, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], whole[line[1:]] != whole[line[:-1]]))) if len(line) else line
    sizes = np.diff(np.concatenate((edges, [len(line)])))
    edges, sizes = edges[sizes > 1], sizes[sizes > 1]
    firsts = line[edges]
    by_place = np.argsort(firsts)
    firsts, edges, sizes = firsts[by_place], edges[by_place], sizes[by_place]
    turn = sort_suffixes(prefix, starts[firsts], group[firsts], limit)
    edges, sizes = edges[turn], sizes[turn]
    order = line[np.repeat(edges - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    a, b = starts[order[:-1]], starts[order[1:]]
    same = (group[order[:-1]] == group[order[1:]]) & (prefix.hashes(a, limit) == prefix.hashes(b, limit))
    at = np.flatnonzero(same)
    strings = np.lib.stride_tricks.sliding_window_view(buffer, limit) if len(at) else None
    for k in range(0, len(at), 50_000):
        part = at[k : k + 50_000]
        true = (strings[a[part]] == strings[b[part]]).all(axis=1)
        same[part[~true]] = False
    out[order[1:][same]] = True
    return out


def window_anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Of every string of ``length`` bytes the place of its anchor, the leftmost gram of least hash; and all gram hashes."""
    found = mix64(Prefix(np.frombuffer(raw, np.uint8)).grams(gram))
    w, n = length - gram + 1, len(found)
    # Half of the hash and the place in one number: their least is the leftmost least.
    packed = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    packed[:n] = (found >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    rows = packed.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), found


def anchor_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of strings with one anchor: (hash, place, first start, last start)."""
    place, found = window_anchors(raw)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    return found[place[first]], place[first], first, last


def _split(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    # Numbers of 16 bits are sorted by radix.
    order = np.argsort(shard.astype(np.uint16) if len(shard) and 0 <= shard.min() and shard.max() < 1 << 16 else shard, kind="stable")
    sorted_ = shard[order]
    edges = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(order) else np.zeros(0, int)
    ends = np.concatenate((edges[1:], [len(order)])) if len(order) else edges
    return order, [(int(sorted_[a]), int(a), int(b)) for a, b in zip(edges, ends, strict=True)]


def _anchors(batches: Iterator[pa.RecordBatch], n_shards: int) -> Iterator[pa.RecordBatch]:
    """Blobs of (hash, text, place) by shard; equal texts of a block once."""

    def flush(parts: list) -> pa.RecordBatch | None:
        if not parts:
            return None
        h = np.concatenate([p[0] for p in parts])
        place = np.concatenate([p[1] for p in parts]).astype(np.uint32)
        text = np.repeat(np.array([p[2] for p in parts], np.int64), [len(p[0]) for p in parts])
        order, cuts = _split((h % np.uint64(n_shards)).astype(np.int64))
        h, place, text = h[order], place[order], text[order]
        rows = [(s, h[a:b].tobytes(), text[a:b].tobytes(), place[a:b].tobytes()) for s, a, b in cuts]
        return _batch(rows, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), ["shard", "h", "t", "p"])

    for batch in batches:
        parts, size, seen = [], 0, set()
        for key, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if len(raw) < LENGTH or key in seen:
                continue
            seen.add(key)
            h, place, _, _ = anchor_runs(raw)
            parts.append((h, place, key))
            size += len(raw)
            if size > BLOCK_BYTES:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _repeated(key: tuple, table: pa.Table, most: int = HOT) -> pa.Table:
    """Of a shard's anchors those that occur twice, by text: places, and which of them more than ``most`` have."""
    h, t, p = _joined(table["h"], np.uint64), _joined(table["t"], np.int64), _joined(table["p"], np.uint32)
    order = np.lexsort((p, t, h))
    h, t, p = h[order], t[order], p[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1]))) if len(h) else np.zeros(0, bool)
    h, t, p = h[new], t[new], p[new]
    _, inverse, sizes = np.unique(h, return_inverse=True, return_counts=True)
    n = sizes[inverse.reshape(-1)]
    twice = n > 1
    t, p, hot = t[twice], p[twice], (n[twice] > most).astype(np.uint32)
    order, cuts = _split(t)
    marked = (p[order] << np.uint32(1) | hot[order]).astype(np.uint32)
    return pa.Table.from_batches([_batch([(s, marked[a:b].tobytes()) for s, a, b in cuts], (pa.int64(), pa.binary()), ["t", "p"])])


RUN_COLUMNS = ["shard", "settled", "g", "d", "t", "s", "n", "o", "body"]
RUN_TYPE = "shard long, settled boolean, g binary, d binary, t binary, s binary, n binary, o binary, body binary"
_RUN_KINDS = (pa.int64(), pa.bool_(), *[pa.binary()] * 7)
#: Of a run: group (hash), doc_id, text, first start, further starts, offset of the anchor from the first start.
_FORM = (np.uint64, np.int64, np.int64, np.uint32, np.uint8, np.uint8)


def _runs(batches: Iterator[pa.RecordBatch], n_shards: int) -> Iterator[pa.RecordBatch]:
    """Runs around repeated anchors, and their bytes, as blobs by shard."""

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([p[k] for p in parts]).astype(kind) for k, kind in enumerate(_FORM)]
        bodies = [body for p in parts for body in p[6]]
        hot = np.concatenate([p[7] for p in parts])
        rows = []
        if hot.any():
            settled, alone, alone_bodies = _settle([x[hot] for x in columns], [b for b, x in zip(bodies, hot, strict=True) if x])
            if len(settled[0]):
                rows.append((int(settled[2][0] % n_shards), True, *(x.tobytes() for x in settled), b""))
            bodies = [b for b, x in zip(bodies, hot, strict=True) if not x] + alone_bodies
            columns = [np.concatenate((x[~hot], y)) for x, y in zip(columns, alone, strict=True)]
        order, cuts = _split((columns[0] % np.uint64(n_shards)).astype(np.int64))
        for shard, a, b in cuts:
            at = order[a:b]
            rows.append((shard, False, *(x[at].tobytes() for x in columns), b"".join(bodies[k] for k in at)))
        yield _batch(rows, _RUN_KINDS, RUN_COLUMNS)

    for batch in batches:
        parts, size = [], 0
        docs, keys, blobs = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for doc, raw, key, blob in zip(docs, texts(batch.column(1)), keys, blobs, strict=True):
            if len(raw) < LENGTH:
                continue
            marked = np.frombuffer(b"".join(blob), np.uint32)
            h, place, first, last = anchor_runs(raw)
            wanted = np.isin(place, marked >> np.uint32(1))
            hot = np.isin(place, (marked >> np.uint32(1))[marked & np.uint32(1) == 1])[wanted]
            h, place, first, last = h[wanted], place[wanted], first[wanted], last[wanted]
            n = len(h)
            if not n:
                continue
            bodies = [raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            parts.append((h, np.full(n, NULL_ID if doc is None else doc), np.full(n, key), first, last - first, place - first, bodies, hot))
            size += sum(map(len, bodies))
            if size > BLOCK_BYTES:
                yield from flush(parts)
                parts, size = [], 0
        if parts:
            yield from flush(parts)


def _strings(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of runs laid end to end, each string: its run, its place in the buffer and in its text, and its group."""
    g, _, _, s, n, o = columns
    counts = n.astype(np.int64) + 1
    size = counts + LENGTH - 1
    of = np.repeat(np.arange(len(s)), counts)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    # Equal strings have equal anchors at equal offsets.
    offset = (o[of].astype(np.int64) - shift).astype(np.uint64)
    return of, (np.cumsum(size) - size)[of] + shift, s[of].astype(np.int64) + shift, mix64(g[of] + offset)


def _settle(columns: list[np.ndarray], bodies: list[bytes]) -> tuple[list, list, list[bytes]]:
    """Runs at hot anchors as single strings: those that an earlier string of the block equals, and the others, grouped by their own hash."""
    buffer = np.frombuffer(b"".join(bodies), np.uint8)
    of, starts, where, _ = _strings(columns)
    group = mix64(Prefix(buffer).hashes(starts, LENGTH))
    _, d, t, _, n, o = (x[of] for x in columns)
    order = np.lexsort((where, t, d, group))
    again = repeats(buffer, starts[order], group[order])

    def single(at: np.ndarray) -> list[np.ndarray]:
        return [x.astype(kind) for x, kind in zip((group[at], d[at], t[at], where[at], 0 * n[at], 0 * o[at]), _FORM, strict=True)]

    raw = buffer.tobytes()
    alone = order[~again]
    return single(order[again]), single(alone), [raw[a : a + LENGTH] for a in starts[alone].tolist()]


def _spans(starts: np.ndarray) -> np.ndarray:
    """Sorted different starts as (first, last) runs."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    edge = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    return np.column_stack((starts[edge], starts[np.concatenate((edge[1:], [len(starts)])) - 1]))


def _by_text(d: np.ndarray, t: np.ndarray, where: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.lexsort((where, d, t))
    t, d, where = t[order], d[order], where[order]
    if not len(t):
        return []
    edges = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (d[1:] != d[:-1]))))
    ends = np.concatenate((edges[1:], [len(t)]))
    return [(int(d[a]), int(t[a]), _spans(np.unique(where[a:b])).astype(np.int64).tobytes()) for a, b in zip(edges.tolist(), ends.tolist(), strict=True)]


def _slices(sorted_groups: np.ndarray, weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole groups that weigh about ``most``."""
    if not len(sorted_groups):
        return
    edges = np.flatnonzero(np.concatenate(([True], sorted_groups[1:] != sorted_groups[:-1])))
    ends = np.concatenate((edges[1:], [len(sorted_groups)]))
    total = np.cumsum(weights)
    start, paid = 0, 0
    for end in ends.tolist():
        if total[end - 1] - paid >= most:
            yield start, end
            start, paid = end, int(total[end - 1])
    if start < len(sorted_groups):
        yield start, len(sorted_groups)


#: Strings that a shard sorts at once, unless one anchor has more.
SORTED_STRINGS = 150_000


def _marks(key: tuple, table: pa.Table, n_shards: int) -> pa.Table:
    """Of a shard's runs the strings that also start earlier, by text, as (first start, last start) pairs, in blobs by shard of the texts."""
    kept, done = table.filter(pc.invert(table["settled"])), table.filter(table["settled"])
    columns = [_joined(kept[c], kind) for c, kind in zip("gdtsno", _FORM, strict=True)]
    body = b"".join(kept["body"].to_pylist())
    sizes = columns[4].astype(np.int64) + LENGTH
    base = np.cumsum(sizes) - sizes
    by_group = np.argsort(columns[0], kind="stable")
    found = [tuple(_joined(done[c], kind) for c, kind in zip("dts", _FORM[1:4], strict=True))]
    for a, b in _slices(columns[0][by_group], columns[4][by_group].astype(np.int64) + 1, SORTED_STRINGS):
        at = by_group[a:b]
        part = [x[at] for x in columns]
        buffer = np.frombuffer(b"".join([body[i : i + n] for i, n in zip(base[at].tolist(), sizes[at].tolist(), strict=True)]), np.uint8)
        of, starts, where, group = _strings(part)
        d, t = part[1][of], part[2][of]
        order = np.lexsort((where, t, d, group))
        group = group[order]
        # A string alone in its group has no equal.
        near = np.zeros(len(order), bool)
        near[1:] = group[1:] == group[:-1]
        near[:-1] |= near[1:]
        order, group = order[near], group[near]
        starts, where, d, t = (x[order] for x in (starts, where, d, t))
        twin = np.zeros(len(t), bool)  # the same string of the same text, from rows equal in id and text
        twin[1:] = (group[1:] == group[:-1]) & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (where[1:] == where[:-1])
        if twin.any():
            starts, where, group, d, t = (x[~twin] for x in (starts, where, group, d, t))
        hit = repeats(buffer, starts, group)
        found.append((d[hit], t[hit], where[hit].astype(np.uint32)))
    rows = _by_text(*(np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3)))
    # One row for each shard of texts, not for each text.
    t = np.array([x[1] for x in rows], np.int64)
    order, cuts = _split((t.view(np.uint64) % np.uint64(n_shards)).astype(np.int64))
    out = []
    for shard, a, b in cuts:
        mine = [rows[k] for k in order[a:b].tolist()]
        out.append((shard, np.array([x[0] for x in mine], np.int64).tobytes(), t[order[a:b]].tobytes(), np.array([len(x[2]) for x in mine], np.uint32).tobytes(), b"".join(x[2] for x in mine)))
    return pa.Table.from_batches([_batch(out, (pa.int64(), *[pa.binary()] * 4), ["shard", "d", "t", "n", "m"])])


def _gathered(key: tuple, table: pa.Table) -> pa.Table:
    """Of a shard of texts the marks of each."""
    d, t, n = _joined(table["d"], np.int64), _joined(table["t"], np.int64), _joined(table["n"], np.uint32).astype(np.int64)
    m = b"".join(table["m"].to_pylist())
    ends = np.cumsum(n)
    order = np.lexsort((d, t))
    edges = np.flatnonzero(np.concatenate(([True], (t[order[1:]] != t[order[:-1]]) | (d[order[1:]] != d[order[:-1]])))).tolist()
    rows = []
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        parts = order[a:b].tolist()
        rows.append((int(d[parts[0]]), int(t[parts[0]]), [b"".join([m[ends[k] - n[k] : ends[k]] for k in parts])]))
    return pa.Table.from_batches([_batch(rows, (pa.int64(), pa.int64(), pa.list_(pa.binary())), ["__d", "__t", "blobs"])])


def cut_out(raw: bytes, spans: np.ndarray, length: int = LENGTH) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and the rest, for (first start, last start) pairs of strings in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1] + length)
    new = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    first = spans[new, 0].tolist()
    last = ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))].tolist()
    rest, at = [], 0
    for a, b in zip(first, last, strict=True):
        rest.append(raw[at:a])
        at = b
    rest.append(raw[at:])
    return sum(last) - sum(first), len(first), b"".join(rest)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, raw, key, blob in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n, spans, rest = cut_out(raw, np.frombuffer(b"".join(blob), np.int64).reshape(-1, 2))
            rows.append((doc, key, n, spans, hashlib.sha256(rest).hexdigest()))
        yield _batch(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), ["__d", "__t", "n_removed", "n_spans", "kept_sha256"])


def _chosen(docs: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__d, text, __t, blobs) of the rows of ``keys`` (__d, __t, blobs), whose texts alone are shuffled."""
    content = F.coalesce(column(text), F.lit(""))
    marked = docs.select(F.coalesce(column(doc_id).cast("long"), F.lit(NULL_ID)).alias("__d"), content.alias("__text"), F.xxhash64(content).alias("__t"))
    rows, spread = flagged(marked, keys.select(F.col("__t").alias("__id")), ["__d", "__text", "__t"], "__t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = spread.value
        for batch in batches:
            place = batch.column(3).to_numpy()
            hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            part = batch.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays(part.columns[:3], names=["__d", "__text", "__t"])

    kept = rows.mapInArrow(run, "__d long, __text string, __t long")
    return kept.join(keys, ["__d", "__t"]).select("__d", "__text", "__t", "blobs")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    content = F.coalesce(column(text), F.lit(""))
    slim = checkpointed(
        docs.select(
            F.coalesce(column(doc_id).cast("long"), F.lit(NULL_ID)).alias("__d"),
            column(doc_id).alias("doc_id"),
            F.xxhash64(content).alias("__t"),
            F.sha2(content.cast("binary"), 256).alias("__sha"),
            F.octet_length(content).cast("long").alias("n_bytes"),
        )
    )
    firsts = checkpointed(slim.groupBy("__sha", "__t").agg(F.min("__d").alias("__d"), F.max("n_bytes").alias("__n")))
    total = firsts.agg(F.sum("__n")).first()[0] or 0
    n_shards = max(8, -(-total // SHARD_BYTES))
    keyed = docs.select(F.xxhash64(content).alias("__t"), content.alias("__text"))
    anchors = keyed.mapInArrow(lambda batches: _anchors(batches, n_shards), "shard long, h binary, t binary, p binary")
    places = anchors.groupBy("shard").applyInArrow(lambda key, table: _repeated(key, table, hot), "t long, p binary")
    by_text = places.groupBy(F.col("t").alias("__t")).agg(F.collect_list("p").alias("blobs"))
    wanted = checkpointed(by_text.join(firsts.select("__t", "__d"), "__t").select("__d", "__t", "blobs"))
    chosen = _chosen(docs, wanted, doc_id, text).dropDuplicates(["__d", "__t"])
    runs = chosen.mapInArrow(lambda batches: _runs(batches, n_shards), RUN_TYPE)
    marks = runs.groupBy("shard").applyInArrow(lambda key, table: _marks(key, table, n_shards), "shard long, d binary, t binary, n binary, m binary")
    spans = checkpointed(marks.groupBy("shard").applyInArrow(_gathered, "__d long, __t long, blobs array<binary>"))
    removed = _chosen(docs, spans, doc_id, text).mapInArrow(_removed, "__d long, __t long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["__d", "__t"])
    # Of equal texts one row is first: by id, and among rows equal in id too any one.
    found = slim.join(firsts.select("__sha", F.col("__d").alias("__first")), "__sha")
    leading = found.where("__d = __first").withColumn("__k", F.row_number().over(Window.partitionBy("__sha").orderBy("__d")))
    long_enough = F.col("n_bytes") >= LENGTH
    gone = found.where("__d <> __first").unionByName(leading.where("__k > 1").drop("__k"))
    copies = gone.select(
        "doc_id",
        "n_bytes",
        F.when(long_enough, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(long_enough, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(long_enough, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("__sha")).alias("kept_sha256"),
    )
    first_rows = leading.where("__k = 1").join(removed, ["__d", "__t"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "__sha").alias("kept_sha256")
    )
    return copies.unionAll(first_rows)
