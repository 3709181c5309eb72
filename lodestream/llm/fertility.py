"""Quality rules on tokeniser fertility.

Two public vocabularies measure every document. One with byte fallback gives characters per token, the share of tokens
that had to fall back to single bytes, and the entropy of the document's tokens in bits; a second one, of byte pairs,
gives characters per token again, as what one vocabulary happens to hold another need not. Bands per language, or per
script where the language has none, reject what lies outside: text that needs more tokens than its language does. A
document also has to pass base rules on its length and repetition.

Words are tokenised one by one with the first vocabulary (it has no piece that spans white space), so that a cache of
words of bounded size in each Python worker does most of the work. The step is narrow: no shuffle, one Arrow batch in
memory.

Defined results: a null or empty text has no words and fails the base rules; a null or unknown language is judged by
the script of its letters; a text of any length is measured whole; repeated rows are judged alike, each on its own; an
empty table gives an empty table; ``filtered`` leaves all columns as they are, whatever they are called.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPACES, column, decoded, mapped, texts, tokenizer_path
from .packing import TokenBytes, token_bytes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Characters that the vocabulary's normaliser may turn into a space or into nothing.
UNSURE = re.compile("[^ -~\u00a1-\u00ac\u00ae-\u024f]")


@dataclass(frozen=True)
class Band:
    """What a document may measure, ends included: characters per token by both vocabularies, at least."""

    chars_per_token: tuple[float, float]
    byte_share: float
    token_entropy: float
    chars_per_pair: float = 0.0


#: By language code. The lower ends lie where some 2 in 1000 good documents of a language fall below.
LANGUAGE_BANDS = {
    "en": Band((2.00, 6.0), 0.02, 5.2, 2.04),
    "de": Band((2.03, 6.0), 0.02, 5.2, 1.86),
    "fr": Band((1.70, 6.0), 0.02, 5.2, 1.69),
    "es": Band((1.79, 6.0), 0.02, 5.2, 1.64),
}
#: By script.
SCRIPT_BANDS = {
    "latin": Band((1.3, 7.0), 0.05, 4.0, 1.2),
    "greek": Band((0.7, 5.0), 0.30, 4.0),
    "cyrillic": Band((0.9, 5.0), 0.20, 4.0),
    "hebrew": Band((0.5, 4.0), 0.60, 3.5),
    "arabic": Band((0.5, 4.0), 0.60, 3.5),
    "indic": Band((0.4, 4.0), 0.80, 3.5),
    "thai": Band((0.3, 4.0), 0.90, 3.5),
    "kana": Band((0.4, 3.0), 0.60, 3.5),
    "han": Band((0.3, 3.0), 0.80, 3.5),
    "hangul": Band((0.3, 3.0), 0.90, 3.5),
    "other": Band((0.2, 10.0), 1.00, 3.5),
}
#: The first and last code point of each script.
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("indic", 0x0900, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]


def script_of(text: str) -> str:
    """The script of most letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    points = points[(points >= 0x80) | ((points | 32) - np.uint32(97) < 26)]
    sizes = {name: int(((points >= low) & (points <= high)).sum()) for name, low, high in SCRIPT_RANGES}
    best = max(sizes, key=sizes.get)
    return best if sizes[best] * 2 > len(points) > 0 else "other"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of three words that the text has at least twice."""
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    twice = {w for w, k in Counter(windows).items() if k > 1}
    hit = np.fromiter(map(twice.__contains__, windows), bool, n - 2)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def repeated_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


class Meter:
    """Tokens of words, by a vocabulary with byte fallback, kept for the words seen lately."""

    #: Words and bytes that are kept.
    LIMIT, BYTES = 400_000, 64_000_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.model.get_piece_size())])
        self.is_start = np.array([self.model.id_to_piece(i).startswith("\u2581") for i in range(self.model.get_piece_size())])
        self.cache: dict[bytes, bytes] = {}
        self.held = 0

    def tokens(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if new := [w for w in set(words) if w not in cache]:
            if len(cache) + len(new) > self.LIMIT or self.held > self.BYTES:
                cache.clear()
                self.held = 0
                new = list(set(words))
            self.learn(new)
            self.held += sum(len(w) + len(cache[w]) for w in new)
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint32)

    def learn(self, new: list[bytes]) -> None:
        """Tokenise new words: in one call where each is sure to give a run of tokens of its own."""
        line = decoded(b" ".join(new))
        if not UNSURE.search(line):
            ids = np.array(self.model.encode_as_ids(line), np.uint32)
            starts = np.flatnonzero(self.is_start[ids])
            if len(starts) == len(new):
                all_ids, ends = ids.tobytes(), (4 * starts).tolist()
                self.cache.update({w: all_ids[a:b] for w, a, b in zip(new, ends, [*ends[1:], None], strict=True)})
                return
        for word, one in zip(new, self.model.encode([decoded(w) for w in new], num_threads=1), strict=True):
            self.cache[word] = array("I", one).tobytes()


_METERS: dict[str, Meter] = {}


def meter(path: str) -> Meter:
    if path not in _METERS:
        _METERS[path] = Meter(path)
    return _METERS[path]


def entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    sizes = np.bincount(ids)
    sizes = sizes[sizes > 0]
    return float(math.log2(len(ids)) - (sizes * np.log2(sizes)).sum() / len(ids))


#: Added columns, in the order in which ``measure`` gives them.
COLUMNS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("chars_per_token", T.DoubleType()),
    ("byte_share", T.DoubleType()),
    ("token_entropy", T.DoubleType()),
    ("band", T.StringType()),
    ("chars_per_pair", T.DoubleType()),
]


def measure(tool: Meter, pairs: TokenBytes, raw: bytes, lang: str | None, languages: dict[str, Band], scripts: dict[str, Band]) -> tuple:
    words = raw.split()
    text = decoded(raw)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > 50 * len(words)
    ids = tool.tokens(words)
    per_token = chars / len(ids) if len(ids) else 0.0
    byte_share = float(tool.is_byte[ids].mean()) if len(ids) else 0.0
    bits = entropy(ids)
    n_pairs = len(pairs.document(text)) // 4
    per_pair = chars / n_pairs if n_pairs else 0.0
    name = lang if lang in languages else script_of(text)
    band = languages.get(name) or scripts[name]
    low, high = band.chars_per_token
    fits = low <= per_token <= high and byte_share <= band.byte_share and bits >= band.token_entropy and per_pair >= band.chars_per_pair
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), chars, symbols, repeated_lines(raw), repeated, failed, not failed and fits, per_token, byte_share, bits, name, per_pair


def with_fertility(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    lang: str = "lang",
    prefix: str = "",
    vocabulary: str | None = None,
    pair_vocabulary: str | None = None,
    languages: dict[str, Band] = LANGUAGE_BANDS,
    scripts: dict[str, Band] = SCRIPT_BANDS,
) -> DataFrame:
    """``keep`` of every row, and the measures and verdict of its whole text under ``prefix``.

    ``vocabulary`` is the path of a sentencepiece model with byte fallback, ``pair_vocabulary`` that of a byte-pair tokenizer; each executor opens them.
    """
    path = vocabulary or tokenizer_path("piece_bpe_32k.model")
    pair_path = pair_vocabulary or tokenizer_path("byte_bpe_50k.json")

    def rows(tools: tuple[Meter, TokenBytes], text_column: pa.Array, lang_column: pa.Array) -> list[pa.Array]:
        made = [measure(*tools, raw, code, languages, scripts) for raw, code in zip(texts(text_column), lang_column.to_pylist(), strict=True)]
        kinds = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
        return [pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*made, strict=True), COLUMNS, strict=True)]

    return mapped(docs, [text, lang], keep, [(prefix + n, t) for n, t in COLUMNS], rows, lambda: (meter(path), token_bytes(pair_path)))


def filtered(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are."""
    prefix = "__q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    out = with_fertility(docs, docs.columns, prefix=prefix, **options)
    return out.where(column(prefix + "kept")).select(*map(column, docs.columns))
