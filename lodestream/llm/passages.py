"""Near-duplicate passages by compact windows of token min-hashes.

A token is a shingle of five words. Under a hash function, every stretch of 46 tokens (50 words) has a least token; the
stretches with the same least token form a compact window (first, least, last): a node of the Cartesian tree over the
token hashes, so a text of n tokens has about n / 23 of them. Passages that resemble each other share least tokens
under most hash functions.

1. A stretch that resembles one of another text at similarity 0.8 shares 41 of its 46 tokens with it. Tokens are dealt
   out by hash as 32-bit marks; those of two texts or more come back to their texts. Only areas of stretches with 41
   such tokens go on: a condition that every near-duplicate passage meets.
2. Areas give their compact windows under eight functions. Every window meets the first window of its token; the
   intervals are aligned at the token, and pairs of areas whose windows overlap by a passage's length under three
   functions or more are verified token by token. Verified links give classes.
3. A token whose windows still lie in several classes is open. All its different windows of different classes are
   compared with their surroundings (at most 91 tokens), in cells of bounded size that return a spanning forest of the
   links they find. So any two texts with resembling passages that share a least token under any function end in one
   class; a stretch at similarity 0.8 shares none of the eight with a chance of 3e-6.
4. Two stretches that share 41 of 46 tokens share one of the six that come first in either, in whatever order of all
   tokens. So windows of an open token that has many are dealt out by the first six, the rarest, of each of their
   stretches, and only those that share such a token are compared: no pair that resembles each other is left out.
   Copies of a passage share many: where meeting by each of them costs more, the windows of an open token meet by it
   alone, all of them.

Tokens that very many texts of a sample have are known to be shared and aren't dealt out: their texts only send how many
they have. Tokens of very many windows get their first window by a broadcast of at most HOT_TOKENS rows, and are dealt out over
salts. What an open token costs is the number of its different windows outside its largest class times all of them, as
a count in memory; one of more than PREFIXED windows pays that, or for each rare token beside it the same among the windows
that have both, whichever is less. How rare a token is comes from a sample, and decides only what is compared, not what is found.

Defined results: texts of fewer than 50 words (null, empty) have no passage and are classes of their own; a text of any
length is read whole; equal texts are one node; a class is named by its least doc_id; repeated rows report the same; an
empty table gives an empty table. ``spans`` are the word ranges that verified links cover in the later of two texts;
a text that joined its class by one passage need not list its others. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import by_cell, cells, common_counts, outside_largest, shingles
from .common import POWERS, among, checkpointed, column, hot_hashes, mix64, removed, small_batches, swept, texts, written
from .components import components
from .suffixes import _batch, _chosen, _joined, _split

TOKENS = 46
SIMILARITY = 0.8
FUNCTIONS, AGREE = 8, 3
BLOCK_BYTES = 4_000_000
SHARD_BYTES = 16_000_000
#: Tokens of more than this share of all windows, and more than so many, are dealt out over SALTS keys.
HOT_TOKENS, HOT_WINDOWS = 1000, 20_000
SALTS = 64
CELL_WINDOWS = 1000
#: Open tokens of more windows are dealt out by rare tokens, whose order is of a sample of windows and holds so many tokens at most.
PREFIXED, RARITY_WINDOWS, RANKED = 64, 50_000, 1 << 16
#: Pairs of windows that cost as much to compare in a cell as to bring a window there.
PAIRS = 100
#: Other bounds of the sample that tells hot tokens than the usual ones.
HOT_SAMPLE: tuple[int, ...] = ()
NULL_ID = -(2**63)


def needed(width: int = TOKENS, similarity: float = SIMILARITY) -> int:
    """The tokens that two stretches of ``width`` have in common at least."""
    return int(np.ceil(2 * similarity * width / (1 + similarity) - 1e-9))


def token_hashes(tokens: np.ndarray, function: int) -> np.ndarray:
    return mix64(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (function + 1) % 2**64))


def compact_windows(hashes: np.ndarray, width: int = TOKENS, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, least, last) of every Cartesian-tree node of ``width`` tokens or more; the leftmost of equals is least.

    A token is such a node just where it is least in some stretch of ``width`` tokens. Within ``width`` of it, its
    bounds follow from the stretches it leads; further off, the next smaller token is a node itself, so a stack over
    the nodes finds it. Places ``between`` separate texts: no window holds one.
    """
    n = len(hashes)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    # Half of the hash and the place in one number: the least is the leftmost of equals, and a place between is less than any token.
    packed = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    packed[:n] = (hashes >> np.uint64(32) | np.uint64(1)) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    if between is not None:
        packed[between] = between.astype(np.uint64)
    rows = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    stop = np.concatenate((edge[1:], [len(least)])) - 1
    at, first, last = least[edge], edge.copy(), stop + width - 1
    value = packed[at].tolist()
    place = at.tolist()
    smaller_before, smaller_after = [-1] * len(at), [n] * len(at)
    stack: list[int] = []
    for k, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            smaller_after[stack.pop()] = place[k]
        if stack:
            smaller_before[k] = place[stack[-1]]
        stack.append(k)
    # A stretch that begins at its least token's own reach doesn't see what lies before it.
    open_left = at == first + width - 1
    open_right = at == stop
    first[open_left] = np.array(smaller_before)[open_left] + 1
    last[open_right] = np.array(smaller_after)[open_right] - 1
    if between is not None:
        tokens = packed[at] >> np.uint64(32) > 0
        first, at, last = first[tokens], at[tokens], last[tokens]
    return first, at, last


def _marks(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32)


def _tokens(batches: Iterator[pa.RecordBatch], n_shards: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blobs by shard: the marks of the different tokens of each text, the texts, and how many marks each has; equal texts of a batch once.

    The highest bit of that number tells a text that repeats so many tokens that fewer marks may make up a stretch. Hot
    tokens are known to be shared and don't travel: shards below 0, by text, hold how many of them a text has.
    """
    names, kinds = ["shard", "v", "t", "n"], (pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def hot_counts(counts: list[tuple[int, int]]) -> pa.RecordBatch:
        t, n = np.array([x for x, _ in counts], np.int64), np.array([x for _, x in counts], np.uint32)
        order, cuts = _split((t.view(np.uint64) % np.uint64(n_shards)).astype(np.int64))
        return _batch([(-1 - s, b"", t[order[a:b]].tobytes(), n[order[a:b]].tobytes()) for s, a, b in cuts], kinds, names)

    def flush(parts: list[tuple[int, np.ndarray, bool]]) -> pa.RecordBatch:
        every = np.concatenate([x for _, x, _ in parts])
        owner = np.repeat(np.arange(len(parts)), [len(x) for _, x, _ in parts])
        keys = np.array([key for key, *_ in parts], np.int64)
        flags = np.array([again for *_, again in parts], np.uint32) << np.uint32(31)
        order, cuts = _split(((every & np.uint64(0xFFFFFFFF)) % np.uint64(n_shards)).astype(np.int64))
        marks, owner = _marks(every[order]), owner[order]
        rows = []
        for shard, a, b in cuts:
            of, n = np.unique(owner[a:b], return_counts=True)
            rows.append((shard, marks[a:b].tobytes(), keys[of].tobytes(), (n.astype(np.uint32) | flags[of]).tobytes()))
        return _batch(rows, kinds, names)

    for batch in batches:
        parts, size, seen, counts = [], 0, set(), []
        for key, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if key in seen:
                continue
            seen.add(key)
            tokens = shingles(raw)
            if len(tokens) < TOKENS:
                continue
            different = np.unique(tokens)
            known, again = among(different, hot), len(tokens) - len(different) > TOKENS - needed()
            if known.any():
                counts.append((key, needed() if again else int(known.sum())))
            parts.append((key, different[~known], again))
            size += len(raw)
            if size > BLOCK_BYTES:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)
        if counts:
            yield hot_counts(counts)


def _shared(key: tuple, table: pa.Table, n_shards: int) -> pa.Table:
    """Of a shard's marks those that two different texts have, as blobs by shard of the texts; counts of hot tokens go on."""
    names, kinds = ["shard", "v", "t", "n", "hot"], (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
    if key[0].as_py() < 0:
        return pa.Table.from_batches([_batch([(-1 - key[0].as_py(), b"", b"".join(table["t"].to_pylist()), b"".join(table["n"].to_pylist()), True)], kinds, names)])
    v, t, n = _joined(table["v"], np.uint32), _joined(table["t"], np.int64), _joined(table["n"], np.uint32)
    again = n >> np.uint32(31) > 0
    owner = np.repeat(np.arange(len(t)), n & np.uint32(2**31 - 1))
    packed = np.sort(v.astype(np.uint64) << np.uint64(32) | np.arange(len(v), dtype=np.uint64))
    order = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = packed[1:] >> np.uint64(32) == packed[:-1] >> np.uint64(32)
    of = np.concatenate(([0], np.cumsum(~same))) if len(v) else np.zeros(0, np.int64)
    by = t[owner[order]]
    several = np.zeros(len(v) + 1, bool)
    several[of[1:][same & (by[1:] != by[:-1])]] = True
    hit = np.sort(order[several[of]])
    owners, counts = np.unique(owner[hit], return_counts=True)
    ends = np.concatenate(([0], np.cumsum(counts)))
    marks, found, flags = v[hit], t[owners], again[owners].astype(np.uint32) << np.uint32(31)
    by_text, cuts = _split((found.view(np.uint64) % np.uint64(n_shards)).astype(np.int64))
    rows = []
    for shard, a, b in cuts:
        at = by_text[a:b]
        rows.append((shard, b"".join([marks[x:y].tobytes() for x, y in zip(ends[at].tolist(), ends[at + 1].tolist(), strict=True)]), found[at].tobytes(), (counts[at].astype(np.uint32) | flags[at]).tobytes(), False))
    return pa.Table.from_batches([_batch(rows, kinds, names)])


def _by_text(key: tuple, table: pa.Table) -> pa.Table:
    """Of a shard of texts those that have enough shared marks and hot tokens, or repeat tokens, and their marks."""
    warm, hot = table.filter(pc.invert(table["hot"])), table.filter(table["hot"])
    v, t, n = _joined(warm["v"], np.uint32), _joined(warm["t"], np.int64), _joined(warm["n"], np.uint32)
    hot_t, hot_n = _joined(hot["t"], np.int64), _joined(hot["n"], np.uint32)
    again, n = n >> np.uint32(31) > 0, (n & np.uint32(2**31 - 1)).astype(np.int64)
    texts_, of = np.unique(np.concatenate((t, hot_t)), return_inverse=True)
    of, of_hot = of.reshape(-1)[: len(t)], of.reshape(-1)[len(t) :]
    # Equal texts of several batches count alike, at least.
    enough = np.bincount(of, n, len(texts_)) + np.bincount(of_hot, hot_n, len(texts_)) >= needed()
    enough |= np.bincount(of, again, len(texts_)) > 0
    order = np.argsort(of, kind="stable")
    starts = np.cumsum(n) - n
    edges = np.searchsorted(of[order], np.arange(len(texts_) + 1))
    rows = []
    for k in np.flatnonzero(enough).tolist():
        parts = order[edges[k] : edges[k + 1]].tolist()
        rows.append((int(texts_[k]), [b"".join([v[starts[p] : starts[p] + n[p]].tobytes() for p in parts])]))
    return pa.Table.from_batches([_batch(rows, (pa.int64(), pa.list_(pa.binary())), ["__t", "blobs"])])


def areas(shared: np.ndarray, width: int = TOKENS, need: int | None = None) -> list[tuple[int, int]]:
    """The unions of the stretches of ``width`` tokens with ``need`` shared ones, as (first, end)."""
    if len(shared) < width:
        return []
    count = np.concatenate(([0], np.cumsum(shared)))
    starts = np.flatnonzero(count[width:] - count[:-width] >= (needed(width) if need is None else need))
    if not len(starts):
        return []
    edge = np.flatnonzero(np.concatenate(([True], np.diff(starts) > width)))
    last = np.concatenate((edge[1:], [len(starts)])) - 1
    return list(zip(starts[edge].tolist(), (starts[last] + width).tolist(), strict=True))


#: Of a window: hash of its least token and of its surroundings, function, area, first, least and last token.
WINDOW = np.dtype([("h", "<i8"), ("x", "<i8"), ("f", "<i4"), ("s", "<i4"), ("a", "<i4"), ("c", "<i4"), ("b", "<i4")])


def _reach(first: np.ndarray, least: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens, ends included, of all stretches of TOKENS tokens that a window has around its least one."""
    return np.maximum(first, least - TOKENS + 1), np.minimum(last, least + TOKENS - 1)


def _windows(tokens: np.ndarray, between: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of areas that lie end to end, each with a place between them after it; and which area each is of."""
    up, down = POWERS.upto(len(tokens) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * down[: len(tokens)])))
    out = []
    for f in range(FUNCTIONS):
        hashes = token_hashes(tokens, f)
        first, least, last = compact_windows(hashes, TOKENS, between)
        low, high = _reach(first, least, last)
        made = np.empty(len(least), WINDOW)
        made["h"] = hashes[least].view(np.int64)
        made["x"] = mix64((sums[high + 1] - sums[low]) * up[low] + ((least - low) * 64 + (high - least)).astype(np.uint64)).view(np.int64)
        made["f"], made["a"], made["c"], made["b"] = f, first, least, last
        out.append(made)
    every = np.concatenate(out)
    area = np.searchsorted(starts, every["c"], side="right") - 1
    order = np.argsort(area, kind="stable")
    return every[order], area[order]


def _areas(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(d, t, tokens, places, windows) of each text with areas: their tokens, a place between them after each, the first token of each area there and in the text, and windows."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        pieces = [tokens[a:b] for *_, tokens, found in held for a, b in found]
        sizes = np.array([len(x) + 1 for x in pieces])
        starts = np.cumsum(sizes) - sizes
        tokens = np.zeros(int(sizes.sum()), np.uint64)
        between = starts + sizes - 1
        inside = np.ones(len(tokens), bool)
        inside[between] = False
        tokens[inside] = np.concatenate(pieces)
        windows, area = _windows(tokens, between, starts)
        rows, at = [], 0
        for doc, key, _, found in held:
            first, end = starts[at], between[at + len(found) - 1] + 1
            low, high = np.searchsorted(area, [at, at + len(found)])
            mine = windows[low:high].copy()
            mine["s"] = area[low:high] - at
            for n in "acb":
                mine[n] -= first
            places = np.column_stack((starts[at : at + len(found)] - first, [a for a, _ in found])).astype(np.int64)
            rows.append((doc, key, tokens[first:end].tobytes(), places.tobytes(), mine.tobytes()))
            at += len(found)
        return _batch(rows, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), ["d", "t", "tokens", "places", "windows"])

    for batch in batches:
        held, size = [], 0
        for doc, raw, key, blob in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            tokens = shingles(raw)
            found = areas(np.isin(_marks(tokens), np.frombuffer(b"".join(blob), np.uint32)) | among(tokens, hot))
            if found:
                held.append((doc, key, tokens, found))
                size += 8 * len(tokens)
            if size > BLOCK_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)


def _exploded(batches: Iterator[pa.RecordBatch], names: str, bits=None, root: bool = False) -> Iterator[pa.RecordBatch]:
    """A row for each window, from (k, windows) or (k, windows, root): k, the fields ``names``, and root; of tokens in the bitmap alone where there is one."""
    held = bits.value if bits is not None else None
    for batch in batches:
        blobs = batch.column(1).to_pylist()
        start = 0
        while start < len(blobs):
            stop, size = start, 0
            while stop < len(blobs) and (stop == start or size + len(blobs[stop]) < 4 * BLOCK_BYTES):
                size += len(blobs[stop])
                stop += 1
            all_ = np.frombuffer(b"".join(blobs[start:stop]), WINDOW)
            of = np.repeat(np.arange(start, stop), [len(x) // WINDOW.itemsize for x in blobs[start:stop]])
            if held is not None:
                place = _place(all_["h"], 8 * len(held))
                hit = np.flatnonzero(held[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                # Of one text's windows with the same surroundings one is enough.
                _, single = np.unique(np.stack((all_["h"][hit], all_["x"][hit], of[hit])), axis=1, return_index=True)
                all_, of = all_[hit[single]], of[hit[single]]
            if len(all_):
                columns = [pa.array(batch.column(0).to_numpy()[of]), *(pa.array(all_[n].copy()) for n in names)]
                labels = ["k", *names]
                if root:
                    columns.append(pa.array(batch.column(2).to_numpy()[of]))
                    labels.append("root")
                yield pa.RecordBatch.from_arrays(columns, names=labels)
            start = stop


def _place(h: np.ndarray, n_bits: int) -> np.ndarray:
    return (mix64(h.view(np.uint64) if h.flags.c_contiguous else h.astype(np.int64).view(np.uint64)) & np.uint64(n_bits - 1)).astype(np.int64)


def _bits_of(opens: DataFrame) -> np.ndarray:
    """A bitmap of the tokens in ``opens`` (h): some sixteen bits for each, at most 32 MB."""
    n_bits = min(1 << 28, max(1 << 16, 1 << (16 * opens.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column(0).to_numpy(), n_bits) + 1)], names=["p"])

    rows = opens.select("h").mapInArrow(run, "p long").groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(n_bits // 8, np.uint8)
    for r in rows:
        piece = np.frombuffer(bytes(r["m"]), np.uint8)
        at = (r["b"] - 1) * len(piece)
        out[at : at + len(piece)] |= piece[: len(out) - at]
    return out


def _first_met(batches: Iterator[pa.RecordBatch], hot: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """Windows beside the first one of their token where they overlap by a passage, from rows (h, salt, k, s, a, c, b, f) sorted by token.

    Gives (rk, rs, k, s, fs, a, b, ra, rb): the pair of areas, the function's bit, and the overlap in both.
    """
    last, first = None, (0, 0, 0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        h, salt, k, s, a, c, b, f = (x.to_numpy() for x in batch.columns)
        new = np.concatenate(([(int(h[0]), int(salt[0])) != last], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])))
        at = np.flatnonzero(new)
        firsts = [first, *zip(k[at].tolist(), s[at].tolist(), a[at].tolist(), c[at].tolist(), b[at].tolist(), strict=True)]
        for j, token in enumerate(h[at].tolist(), 1):
            firsts[j] = hot.get(token, firsts[j])
        rk, rs, ra, rc, rb = np.array(firsts, np.int64)[np.cumsum(new)].T
        last, first = (int(h[-1]), int(salt[-1])), firsts[-1]
        left, right = np.minimum(c - a, rc - ra), np.minimum(b - c, rb - rc)
        near = (k != rk) & (left + right + 1 >= TOKENS)
        made = (rk, *(x.astype(np.int32) if x is not k else x for x in (rs, k, s, 1 << f, c - left, c + right, rc - left, rc + right)))
        yield pa.RecordBatch.from_arrays([pa.array(x[near]) for x in made], names=["rk", "rs", "k", "s", "fs", "a", "b", "ra", "rb"])


def passages_of(mine: np.ndarray, other: np.ndarray, width: int = TOKENS, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Stretches of ``mine`` (token ranges, merged) whose ``width`` tokens resemble a stretch of ``other``, as multisets; at least one where there is any."""
    need = needed(width, similarity)
    if len(mine) < width or len(other) < width:
        return []
    order = np.argsort(other, kind="stable")
    ranked = other[order]
    low, high = np.searchsorted(ranked, mine), np.searchsorted(ranked, mine, side="right")
    there = high > low
    count = np.concatenate(([0], np.cumsum(there)))
    starts = np.flatnonzero(count[width:] - count[:-width] >= need)
    if not len(starts):
        return []
    at = np.where(there, order[np.minimum(low, len(order) - 1)], -1)
    # Most stretches stand in both along a few shifts.
    shift = at - np.arange(len(mine))
    shifts, votes = np.unique(shift[there], return_counts=True)
    ok = np.zeros(len(starts), bool)
    for k in np.argsort(-votes, kind="stable")[:4].tolist():
        count = np.concatenate(([0], np.cumsum(there & (shift == shifts[k]))))
        ok |= (count[width:] - count[:-width])[starts] >= need
    # Others where enough different tokens stand within a stretch's length.
    seen = np.argsort(mine, kind="stable")
    before = np.full(len(mine), -1)
    again = mine[seen[1:]] == mine[seen[:-1]]
    before[seen[1:][again]] = seen[:-1][again]
    rest = np.flatnonzero(~ok)
    for k in range(0, len(rest), 20_000):
        part = rest[k : k + 20_000]
        s = starts[part]
        spots = np.lib.stride_tricks.sliding_window_view(at, width)[s]
        fresh = np.lib.stride_tricks.sliding_window_view(before, width)[s] < s[:, None]
        spots = np.sort(np.where(fresh & (spots >= 0), spots, np.iinfo(np.int64).max // 2), axis=1)
        ends, begins = spots[:, need - 1 :], spots[:, : width - need + 1]
        ok[part] = ((ends - begins < width) & (ends < len(other))).any(axis=1)
    if not ok.any() and (again.any() or (high - low).max() > 1):
        for j, s in enumerate(starts.tolist()):  # tokens that stand in several places: all of them
            tokens, where = np.unique(mine[s : s + width], return_index=True)
            places = np.unique(np.concatenate([order[low[s + w] : high[s + w]] for w in where]))
            inside = np.searchsorted(places, places + width) - np.arange(len(places))
            bag = Counter(mine[s : s + width].tolist())
            for m in places[inside >= need].tolist():
                m = min(m, len(other) - width)
                if sum((bag & Counter(other[m : m + width].tolist())).values()) >= need:
                    ok[j] = True
                    break
            if ok[j]:
                break
    out: list[list[int]] = []
    for s in starts[ok].tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = s + width
        else:
            out.append([s, s + width])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, slice) from (tokens, wanted: pairs p with their first and last token)."""
    for batch in batches:
        rows, size = [], 0
        for raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in wanted:
                rows.append((x["p"], raw[8 * x["a"] : 8 * x["b"] + 8]))
                size += len(rows[-1][1])
                if size > BLOCK_BYTES:
                    yield _batch(rows, (pa.int64(), pa.binary()), ["p", "slice"])
                    rows, size = [], 0
        if rows:
            yield _batch(rows, (pa.int64(), pa.binary()), ["p", "slice"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, u, spans) of the pairs that resemble each other, from (rk, k, a, mine, other); spans are token ranges of u's areas."""
    for batch in batches:
        rows = []
        for rk, k, a, mine, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = passages_of(np.frombuffer(mine, np.uint64), np.frombuffer(other, np.uint64))
            if found:
                rows.append((rk, k, [[a + x, a + y] for x, y in found]))
        yield _batch(rows, (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32()))), ["v", "u", "spans"])


def _sliced(pairs: DataFrame, key: str, low: str, high: str, held: DataFrame, salted: bool) -> DataFrame:
    """(p, slice) of every pair: tokens ``low`` to ``high`` of the text in ``key``."""
    salt = F.pmod(F.xxhash64("p"), F.lit(SALTS)) if salted else F.lit(0).cast("long")
    lists = pairs.groupBy(F.col(key).alias("k"), salt.alias("salt")).agg(F.collect_list(F.struct("p", F.col(low).alias("a"), F.col(high).alias("b"))).alias("wanted"))
    return held.select("k", "tokens").join(lists, "k").select("tokens", "wanted").mapInArrow(_cut, "p long, slice binary")


def _star_links(held: DataFrame) -> DataFrame:
    """(v, u, spans) of verified pairs of texts, each window beside the first one of its token."""
    windows = held.select("k", "windows").mapInArrow(lambda batches: _exploded(batches, "hfsacb"), "k long, h long, f int, s int, a int, c int, b int")
    heavy = windows.agg(F.expr(f"approx_top_k(h, {HOT_TOKENS}, 16384)").alias("top"), F.count(F.lit(1)).alias("n")).first()
    most = max(HOT_WINDOWS, (heavy["n"] or 0) // HOT_TOKENS)
    tokens = [x["item"] for x in heavy["top"] or [] if x["count"] > most]
    salt, hot = F.lit(0).cast("long"), {}
    if tokens:
        # At most HOT_TOKENS tokens can have more than that share of all windows.
        is_hot = F.col("h").isin(tokens)
        salt = F.when(is_hot, F.pmod(F.xxhash64("k", "c"), F.lit(SALTS))).otherwise(0)
        hot = {r["h"]: tuple(r["r"]) for r in windows.where(is_hot).groupBy("h").agg(F.min(F.struct("k", "s", "a", "c", "b")).alias("r")).collect()}
    dealt = windows.withColumn("salt", salt).select("h", "salt", "k", "s", "a", "c", "b", "f").repartition("h", "salt").sortWithinPartitions("h", "salt", "k", "s", "c")
    met = dealt.mapInArrow(lambda batches: _first_met(batches, hot), "rk long, rs int, k long, s int, fs int, a int, b int, ra int, rb int")
    agreed = met.groupBy("rk", "rs", "k", "s").agg(F.bit_or("fs").alias("fs"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("ra").alias("ra"), F.max("rb").alias("rb"))
    pairs = checkpointed(agreed.where(F.bit_count("fs") >= AGREE).drop("fs").withColumn("p", F.monotonically_increasing_id()))
    swept(held.sparkSession)
    mine = _sliced(pairs, "k", "a", "b", held, False).withColumnRenamed("slice", "mine")
    other = _sliced(pairs, "rk", "ra", "rb", held, True).withColumnRenamed("slice", "other")
    both = pairs.select("p", "rk", "k", "a").join(mine, "p").join(other, "p").select("rk", "k", "a", "mine", "other")
    return checkpointed(both.mapInArrow(_verified, "v long, u long, spans array<array<int>>"))


def _surrounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, root, node, low, many, around): open windows with the tokens around them, from (k, tokens, wanted)."""
    kinds, names = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), ["key", "root", "node", "low", "many", "around"]
    for batch in batches:
        rows, size = [], 0
        for k, raw, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = _reach(*(np.array([x[n] for x in wanted], np.int64) for n in "acb"))
            for x, a, b in zip(wanted, low.tolist(), high.tolist(), strict=True):
                rows.append((x["h"], x["root"], k, a, x["many"], raw[8 * a : 8 * b + 8]))
                size += len(rows[-1][5])
                if size > BLOCK_BYTES:
                    yield _batch(rows, kinds, names)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, kinds, names)


def rarest(around: list[np.ndarray], ranked: np.ndarray, width: int = TOKENS, need: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(window, token) of the tokens that are among the first ``width - need + 1`` of some stretch of their window, repeats counted.

    First come tokens that aren't ``ranked``, by hash, then these, in the order given. Windows that hold stretches with
    ``need`` tokens in common have such a token in common.
    """
    first = width - (needed(width) if need is None else need) + 1
    by_hash = np.argsort(ranked, kind="stable")
    known = ranked[by_hash]
    windows, found = [], []
    for start in range(0, len(around), 256):
        part = around[start : start + 256]
        sizes = np.array([len(x) for x in part])
        tokens, of = np.unique(np.concatenate(part), return_inverse=True)
        place = np.zeros(len(tokens), np.int64)
        hot = among(tokens, known)
        place[hot] = by_hash[np.searchsorted(known, tokens[hot])] + 1
        order = np.lexsort((tokens, place))
        at = np.empty(len(tokens), np.int32)
        at[order] = np.arange(len(tokens), dtype=np.int32)
        rows = np.zeros((len(part), max(width, int(sizes.max()))), np.int32)
        rows[np.arange(rows.shape[1]) < sizes[:, None]] = at[of.reshape(-1)]
        stretches = np.lib.stride_tricks.sliding_window_view(rows, width, axis=1)
        whole = np.arange(stretches.shape[1]) <= (sizes - width)[:, None]
        window = np.repeat(np.arange(len(part)), whole.sum(axis=1) * first)
        least = np.partition(stretches[whole], first - 1, axis=1)[:, :first].reshape(-1)
        single = np.unique(window << 32 | least)
        windows.append(start + (single >> 32))
        found.append(tokens[order[single & 0xFFFFFFFF]])
    return (np.concatenate(windows), np.concatenate(found)) if windows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _ranked(wide: DataFrame) -> np.ndarray:
    """The tokens that most windows of a sample have, the rarer first."""
    share = min(1.0, RARITY_WINDOWS / max(1, wide.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n)], names=["token", "n"])

    sample = wide.where(F.pmod(F.xxhash64(F.lit(6), "w"), F.lit(1 << 30)) < int((1 << 30) * share)).select("around")
    counts = sample.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(RANKED).collect()
    return np.array([r["token"] for r in reversed(counts)], np.int64).view(np.uint64)


def _cost(rooted: DataFrame) -> DataFrame:
    """(token, cost): what the ``cells`` of an open token's buckets cost, in rows, from rows (w, token, key, root)."""
    parts = rooted.groupBy("token", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("w")).alias("x"))
    whole = parts.groupBy("token", "key").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.max("n").alias("main"), F.bit_xor("x").alias("x"))
    open_ = whole.where("roots > 1").groupBy("token", "n", "x").agg(F.max("main").alias("main")).withColumn("rest", F.col("n") - F.col("main"))
    of_main, of_rest = (F.ceil(F.col(n) / CELL_WINDOWS) for n in ("main", "rest"))
    rows = F.when(of_main + of_rest == 2, F.col("n")).otherwise(F.col("rest") * (of_rest + of_main) + F.col("main") * of_rest)
    return open_.groupBy("token").agg(F.sum(rows + F.col("rest") * F.col("n") / PAIRS).alias("cost"))


def _dealt(around: DataFrame) -> DataFrame:
    """(key, cell, root, node, low, around): the windows of open tokens in cells, from rows (w, key, root, node, low, many, around)."""
    deal = lambda rooted: cells(rooted.withColumn("size", F.lit(TOKENS).cast("long")), CELL_WINDOWS, CELL_WINDOWS * TOKENS * 2, "w", 2).select("w", "key", "cell")
    wide = around.where("many")
    ranked = around.sparkSession.sparkContext.broadcast(_ranked(wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, token = rarest([np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()], ranked.value)
            if len(at):
                w, key, root = (batch.column(c).to_numpy()[at] for c in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(key), pa.array((mix64(token) ^ key.view(np.uint64)).view(np.int64)), pa.array(root)], names=["w", "token", "key", "root"])

    by_rare = written(wide.select("w", "key", "root", "around").mapInArrow(run, "w long, token long, key long, root long"))
    swept(around.sparkSession)
    # Windows that would meet by many rare tokens meet once, by their open token, where that costs less.
    once = _cost(wide.select("w", F.col("key").alias("token"), "key", "root")).withColumnRenamed("cost", "once")
    less = written(_cost(by_rare).join(once, "token").where("once < cost").select("token"))
    swept(around.sparkSession)
    together = around.where("not many").select("w", "key", "root").unionAll(wide.select("w", "key", "root").join(less.select(F.col("token").alias("key")), "key", "left_semi").select("w", "key", "root"))
    apart = by_rare.join(less, "token", "left_anti").select("w", "key", "root")
    return deal(together).unionAll(deal(apart)).join(around.select("w", "root", "node", "low", "around"), "w").select("key", "cell", "root", "node", "low", "around")


def _bags(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``members`` of the multisets of tokens of each owner, and their owners."""
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    at = np.arange(len(tokens))
    new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])))
    turn = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(turn == 0, tokens, mix64(tokens + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), owner


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (v, u, spans) between different classes of a cell, from rows (key, cell, root, node, low, around) sorted by cell."""
    need = needed()
    for cell in by_cell(batches, 2):
        root, node, low = (cell.column(n).to_numpy() for n in ("root", "node", "low"))
        around = [np.frombuffer(x, np.uint64) for x in cell.column("around").to_pylist()]
        n = len(around)
        rest = outside_largest(np.unique(root, return_inverse=True)[1].reshape(-1))
        common = common_counts(*_bags(np.concatenate(around), np.repeat(np.arange(n), list(map(len, around)))), n, rest)
        i, j = np.nonzero((common >= need - 0.5) & (root[rest, None] != root[None, :]))
        i = rest[i]
        merged = {r: r for r in root.tolist()}

        def top(r: int) -> int:
            while merged[r] != r:
                merged[r] = merged[merged[r]]
                r = merged[r]
            return r

        rows = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = top(int(root[x])), top(int(root[y]))
            if a == b:
                continue
            v, u = (x, y) if node[x] < node[y] else (y, x)
            found = passages_of(around[u], around[v])
            if found:
                merged[a] = b
                rows.append((int(node[v]), int(node[u]), [[int(low[u]) + s, int(low[u]) + e] for s, e in found]))
        yield _batch(rows, (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32()))), ["v", "u", "spans"])


def _open_links(held: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between texts of different classes (k, root) whose windows share a token."""
    rooted = held.select("k", "windows").join(roots, "k", "left").select("k", "windows", F.coalesce("root", "k").alias("root"))
    every = rooted.mapInArrow(lambda batches: _exploded(batches, "h", root=True), "k long, h long, root long")
    opens = checkpointed(every.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h"))
    bits = held.sparkSession.sparkContext.broadcast(_bits_of(opens))
    chosen = rooted.mapInArrow(lambda batches: _exploded(batches, "hxacb", bits, True), "k long, h long, x long, a int, c int, b int, root long").join(opens, "h", "left_semi")
    swept(held.sparkSession)
    # One window for each surroundings of a class.
    single = checkpointed(chosen.groupBy("h", "root", "x").agg(F.min(F.struct("k", "a", "c", "b")).alias("w")))
    many = single.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PREFIXED).select("h", F.lit(True).alias("many"))
    marked = single.join(many, "h", "left").select("h", "root", "w.*", F.coalesce("many", F.lit(False)).alias("many"))
    lists = marked.groupBy("k").agg(F.collect_list(F.struct("h", "root", "a", "c", "b", "many")).alias("wanted"))
    around = held.select("k", "tokens").join(lists, "k").select("k", "tokens", "wanted").mapInArrow(_surrounded, "key long, root long, node long, low int, many boolean, around binary")
    around = written(around.withColumn("w", F.monotonically_increasing_id()))
    swept(held.sparkSession)
    dealt = _dealt(around).repartition("key", "cell").sortWithinPartitions("key", "cell")
    links = checkpointed(dealt.mapInArrow(_settled, "v long, u long, spans array<array<int>>"))
    removed(held.sparkSession, around.inputFiles()[0].rpartition("/")[0])
    return links


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, spans) as word ranges of the text, from (k, places, spans)."""
    for batch in batches:
        rows = []
        for k, raw, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            places = np.frombuffer(raw, np.int64).reshape(-1, 2)
            merged: list[list[int]] = []
            for a, b in sorted(map(tuple, spans)):
                area = int(np.searchsorted(places[:, 0], a, side="right")) - 1
                by = int(places[area, 1] - places[area, 0])
                if merged and a + by <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b + by)
                else:
                    merged.append([a + by, b + by])
            rows.append((k, ",".join(f"{a}-{b + 4}" for a, b in merged)))
        yield _batch(rows, (pa.int64(), pa.string()), ["k", "spans"])


def near_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, class_size, and spans (word ranges, ends excluded, that verified links cover)."""
    content = F.coalesce(column(text), F.lit(""))
    # The split ends with the fiftieth word.
    long_enough = F.size(F.split(F.btrim(content, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", TOKENS + 4)) >= TOKENS + 4
    id_ = column(doc_id).cast("long")
    slim = checkpointed(
        docs.select(
            F.coalesce(id_, F.lit(NULL_ID)).alias("d"), id_.alias("doc_id"), F.xxhash64(content).alias("t"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("sha"),
            F.octet_length(content).cast("long").alias("n"), long_enough.alias("long_enough"),
        )
    )
    firsts = checkpointed(slim.groupBy("sha", "t").agg(F.min("d").alias("d"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    n_shards = max(8, -(-total // SHARD_BYTES))
    keyed = docs.select(F.xxhash64(content).alias("t"), content.alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_hashes(keyed, firsts.count(), shingles, *HOT_SAMPLE))
    blobs = keyed.mapInArrow(lambda batches: _tokens(batches, n_shards, hot.value), "shard long, v binary, t binary, n binary")
    replies = blobs.groupBy("shard").applyInArrow(lambda key, table: _shared(key, table, n_shards), "shard long, v binary, t binary, n binary, hot boolean")
    marks = replies.groupBy("shard").applyInArrow(_by_text, "__t long, blobs array<binary>")
    wanted = marks.join(firsts.select(F.col("t").alias("__t"), F.col("d").alias("__d")), "__t")
    wanted = checkpointed(wanted.select("__d", "__t", "blobs"))
    swept(docs.sparkSession)
    with small_batches(docs.sparkSession):
        chosen = _chosen(docs, wanted, doc_id, text).dropDuplicates(["__d", "__t"])
        found = chosen.mapInArrow(lambda batches: _areas(batches, hot.value), "d long, t long, tokens binary, places binary, windows binary")
        held = written(found.withColumn("k", F.monotonically_increasing_id()))
        swept(docs.sparkSession)
        links = _star_links(held)
        swept(docs.sparkSession)
        roots = components(links.select("u", "v"), sweep=True).select(F.col("node").alias("k"), "root")
        links = links.unionAll(_open_links(held, roots))
    swept(docs.sparkSession)
    roots = components(links.select("u", "v"), sweep=True).select(F.col("node").alias("k"), "root")
    of_links = links.select(F.col("u").alias("k"), F.explode("spans").alias("span")).groupBy("k").agg(F.collect_list("span").alias("spans"))
    spans = held.select("k", "places").join(of_links, "k").mapInArrow(_spans, "k long, spans string")
    texts_ = held.select("k", "d", "t").join(roots, "k", "left").join(spans, "k", "left").select("d", "t", F.coalesce("root", "k").alias("root"), "spans")
    named = firsts.join(texts_, ["d", "t"], "left")
    classes = named.where("root IS NOT NULL").groupBy("root").agg(F.min("d").alias("class_id"), F.sum("copies").alias("class_size"))
    # A text without areas is alone in its class, with its copies.
    alone = named.where("root IS NULL").select("sha", F.col("d").alias("class_id"), F.col("copies").alias("class_size"), "spans")
    of_text = named.join(classes, "root").select("sha", "class_id", "class_size", "spans").unionAll(alone)
    own = F.col("long_enough")
    return slim.join(of_text, "sha").select(
        "doc_id",
        F.when(own, F.nullif("class_id", F.lit(NULL_ID))).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(own, F.col("class_size")).otherwise(F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
