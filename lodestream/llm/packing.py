"""Best-fit packing of documents into fixed sequences.

A document is its token ids and an end id. One longer than a sequence is cut into whole sequences, its first piece
taking the remainder. Pieces meet bins online: a fixed number of bins is open, a bitset keyed by free space finds the
fullest open bin that still takes a piece, and when too many are open the fullest closes. Only slim rows (id, piece,
length) are shuffled, in groups of bounded size; tokens are counted and checksummed where the text is read.

Pieces of a group arrive in the order of a hash, and a lookahead of ``LOOKAHEAD`` pieces goes longest first. With 1024 open
bins a stream of 32768 pieces closes some 6000 bins early and takes 0.3 % more sequences than the bound of its tokens;
without the lookahead it would be 2.7 %.

Defined results: a null or empty text is one piece with the end id alone; a text of any length is cut and packed whole;
repeated rows are packed each on its own, and rows without a doc_id too; pieces that tie in the hash follow id, piece and
checksum; an empty table gives an empty table. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, decoded, texts, tokenizer_path

WIDTH = 1024
END_ID = 2
OPEN_BINS = 1024
LOOKAHEAD = 2048
GROUP_PIECES = 32_768


#: Characters beyond these are left to the reference tokenizer: libraries differ in the age of their Unicode tables.
RARE = re.compile("[^\x00-\u024f]")


class TokenBytes:
    """The ids of whole texts, as little-endian 32-bit numbers.

    A faster library reads the same vocabulary, where its ranks lie beside the tokenizer's file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.fast = self._fast(os.path.splitext(path)[0] + ".tiktoken")

    def _fast(self, ranks_path: str):
        if not os.path.exists(ranks_path):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> bytes:
        """By the tokenizer itself."""
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def document(self, text: str) -> bytes:
        if self.fast is None or RARE.search(text):
            return self.ids(text)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


_TOKENS: dict[str, TokenBytes] = {}


def token_bytes(path: str) -> TokenBytes:
    if path not in _TOKENS:
        _TOKENS[path] = TokenBytes(path)
    return _TOKENS[path]


def cut(n: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): whole pieces of ``width`` after a first one with the remainder."""
    at, piece = 0, 0
    while at < n:
        length = n % width or width if at == 0 else width
        yield piece, at, length
        at, piece = at + length, piece + 1


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = token_bytes(path)
        for batch in batches:
            out: list[tuple] = []
            for key, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = tool.document(decoded(raw)) + end
                out += [(key, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, at, n in cut(len(ids) // 4, width)]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    slim = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best fit with at most ``open_bins`` open: bit f of ``levels`` is set where an open bin has f free."""

    def __init__(self, width: int, open_bins: int):
        self.width, self.limit = width, open_bins
        self.levels, self.n_open, self.n_closed = 0, 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(width + 1)]
        self.bins: list[list] = []

    def _hold(self, members: list, free: int) -> None:
        if free <= 0:
            return
        self.by_free[free].append(members)
        self.levels |= 1 << free
        self.n_open += 1
        if self.n_open > self.limit:  # the fullest closes: the lowest bit
            self._take((self.levels & -self.levels).bit_length() - 1)
            self.n_closed += 1

    def _take(self, free: int) -> list:
        members = self.by_free[free].pop()
        if not self.by_free[free]:
            self.levels &= ~(1 << free)
        self.n_open -= 1
        return members

    def add(self, item, length: int) -> None:
        fitting = self.levels >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            members = self._take(free)
        else:
            free, members = self.width, []
            self.bins.append(members)
        members.append((item, length))
        self._hold(members, free - length)


def arrival(lengths: list[int], lookahead: int = LOOKAHEAD) -> list[int]:
    """The order in which pieces meet the bins: longest first within each run of ``lookahead``."""
    return [k for at in range(0, len(lengths), lookahead) for k in sorted(range(at, min(at + lookahead, len(lengths))), key=lambda k: -lengths[k])]


def packed(items: list[tuple[object, int]], width: int = WIDTH, open_bins: int = OPEN_BINS) -> list[list[tuple[object, int]]]:
    """Bins of (item, length), in the order of arrival."""
    fit = BestFit(width, open_bins)
    for item, length in items:
        fit.add(item, length)
    return fit.bins


def _pack_group(key: tuple, table: pa.Table, width: int, open_bins: int, lookahead: int) -> pa.Table:
    table = table.sort_by([(c, "ascending") for c in ("__order", "doc_id", "piece", "ids_crc32", "length")])
    lengths = table.column("length").to_pylist()
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    base = key[0].as_py() << 32
    for k, members in enumerate(packed([(row, lengths[row]) for row in arrival(lengths, lookahead)], width, open_bins)):
        at = 0
        for row, length in members:
            sequence[row], offset[row] = base + k, at
            at += length
    return table.drop_columns(["__group", "__order"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))


def pack(made: DataFrame, width: int = WIDTH, open_bins: int = OPEN_BINS, lookahead: int = LOOKAHEAD, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset. Whole pieces are sequences by themselves; the rest is packed in groups."""
    made = checkpointed(made)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    short = made.where(F.col("length") < width)
    n_groups = max(1, -(-short.count() // group_pieces))
    # By row number, so that neither repeated rows nor rows without an id gather in one group.
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups))
    rest = short.select(*columns, F.xxhash64(*columns).alias("__order"), group.alias("__group"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    grouped = rest.groupBy("__group").applyInArrow(lambda key, table: _pack_group(key, table, width, open_bins, lookahead), schema)
    # Numbers of whole pieces stay clear of the groups' by their sign.
    whole = made.where(F.col("length") >= width).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(grouped)


def packed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return pack(pieces(docs, doc_id, text, **{k: options.pop(k) for k in ("vocabulary", "end_id") if k in options}), **options)
