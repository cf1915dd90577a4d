"""Byte-pair encoding and decoding: a contiguous array of boundaries and ranks per word, merged smallest rank first."""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from asklens.llm.shipping import Shipped

PATH = "/opt/tokenizers/word_bpe_49k.json"
SHORT = 64             # byte symbols of a word up to which the array is scanned; longer words use a heap
MOST_WORDS = 200_000   # distinct words that a task remembers; others are merged anew each time
_ROWS = 256            # texts of a batch handed on
NEVER = sys.maxsize    # the rank of two parts that do not merge
ENCODED = StructType([StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
# White space of the vocabulary's pattern, and its contractions, which come before words.
SPACE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# Fixed values: (first, last, step to the small letter) of capitals younger than this Python's character tables.
YOUNG_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
                  (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
                  (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))


# Letters and numerals of Unicode 16, which this Python's tables (15.1) do not know yet, as first and last.
YOUNG_LETTERS = ((0x1C89, 0x1C8A), (0xA7CC, 0xA7CD), (0xA7DA, 0xA7DB), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
                 (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
                 (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
                 (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
YOUNG_NUMERALS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
                  (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def byte_symbols() -> dict[int, str]:
    """The visible character that stands for each byte: itself where it is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _ranges(kind: str, young: tuple[tuple[int, int], ...], last: int) -> str:
    """The characters up to ``last`` of a general category as ranges of a character class."""
    out: list[list[int]] = []
    for c in range(last + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*out, *(r for r in young if r[1] <= last)])


def word_pattern(last: int) -> str:
    """The pattern of a word for texts without characters beyond ``last``."""
    letters, numerals = _ranges("L", YOUNG_LETTERS, last), _ranges("N", YOUNG_NUMERALS, last)
    return f"{CONTRACTIONS}|[{letters}]+|[{numerals}]|[^{SPACE}{letters}{numerals}]+"


@dataclass(frozen=True)
class Vocabulary:
    """Token texts by id, ranks of the pairs that merge, and how texts are cut into words."""

    tokens: list[str]                 # by id
    ranks: dict[int, int]             # of a pair of ids (left * 2 ** 32 + right) that merges
    made: list[int]                   # id of what a rank's pair becomes
    suffix: str                       # closes the last symbol of a word
    special: tuple[str, ...]          # texts that are tokens as they stand, before anything else
    words: tuple[tuple[int, str], ...]  # last character, and the pattern of a word in texts up to it; the last one for any text

    @classmethod
    def read(cls, path: str = PATH) -> Vocabulary:
        """From a tokenizer file, on the driver; a file of another make is refused rather than encoded otherwise."""
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, steps = made["model"], [s["type"] for s in made["normalizer"]["normalizers"]]
        cuts = [s["type"] for s in made["pre_tokenizer"]["pretokenizers"]]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if (model["type"], steps, cuts, made["decoder"]) != ("BPE", ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None) \
                or not plain or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
            raise ValueError(f"{path} is no lower-case byte-pair vocabulary with word ends")
        numbers = dict(model["vocab"]) | {t["content"]: t["id"] for t in made["added_tokens"]}
        tokens = [""] * (1 + max(numbers.values()))
        for text, number in numbers.items():
            tokens[number] = text
        ranks, becomes = {}, []
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks[numbers[left] << 32 | numbers[right]] = k
            becomes.append(numbers[left + right])
        return cls(tokens, ranks, becomes, model["end_of_word_suffix"] or "",
                   tuple(sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)),
                   tuple((last, word_pattern(last)) for last in (0x7F, 0xFFFF, sys.maxunicode)))


def merged_short(parts: list[int], made: Vocabulary) -> list[int]:
    """Ids of the parts that the symbols ``parts`` of a word merge into; the list is used up.

    ``near[k]`` is the rank of part k with the next one. The smallest rank (the leftmost of equal ones) is looked for by a scan;
    the boundary behind its part is deleted and the ranks on both sides of the new part are looked up again.
    """
    rank = made.ranks.get
    near = [rank(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
    while near:
        least = min(near)
        if least == NEVER:
            break
        k = near.index(least)
        new = parts[k] = made.made[least]
        del parts[k + 1], near[k]
        if k:
            near[k - 1] = rank(parts[k - 1] << 32 | new, NEVER)
        if k < len(near):
            near[k] = rank(new << 32 | parts[k + 1], NEVER)
    return parts


def merged_long(parts: list[int], made: Vocabulary) -> list[int]:
    """The same ids by a heap over linked parts, for words where repeated scans would take squared time."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def rank(k: int) -> int:
        return NEVER if k < 0 or after[k] >= n else made.ranks.get(parts[k] << 32 | parts[after[k]], NEVER)

    near = [rank(k) for k in range(n)]
    heap = [(r, k) for k, r in enumerate(near) if r != NEVER]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        if near[k] != r:
            continue
        parts[k], gone = made.made[r], after[k]
        after[k], near[gone] = after[gone], NEVER
        if after[k] < n:
            before[after[k]] = k
        for b in (before[k], k):
            if b >= 0:
                near[b] = rank(b)
                if near[b] != NEVER:
                    heapq.heappush(heap, (near[b], b))
    out, k = [], 0
    while k < n:
        out.append(parts[k])
        k = after[k]
    return out


class _Words(dict):
    """Ids of words seen, up to a number of them, as little-endian 32-bit integers."""

    def __init__(self, made: Vocabulary):
        self.made, symbols, numbers = made, byte_symbols(), {t: k for k, t in enumerate(made.tokens)}
        self.inner = [numbers[symbols[b]] for b in range(256)]
        self.last = [numbers[symbols[b] + made.suffix] for b in range(256)]

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        parts = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        short = len(parts) <= SHORT
        parts = (merged_short if short else merged_long)(parts, self.made)
        ids = struct.pack(f"<{len(parts)}I", *parts)
        if short and len(self) < MOST_WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Whole texts to ids and back, inside a task."""

    def __init__(self, made: Vocabulary):
        self.tokens = made.tokens
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in made.special) + ")") if made.special else None
        self.words = _Words(made)
        self.patterns = [(re.compile(f"[^\\x00-\\U{last:08x}]"), re.compile(word)) for last, word in made.words]
        self.specials = {t: made.tokens.index(t).to_bytes(4, "little") for t in made.special}
        self.young = {c: chr(c + step) for a, b, step in YOUNG_CAPITALS for c in range(a, b + 1)}
        self.capital = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b, _ in YOUNG_CAPITALS) + "]")

    def normal(self, text: str) -> str:
        """Composed and lower-cased letter by letter (a sigma does not ask what follows)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.capital.search(text):
                text = text.translate(self.young)
        return text.lower()

    def cuts(self, text: str) -> list[str]:
        """Words of a normal text, by the smallest pattern that knows all its characters (large classes are slow)."""
        for beyond, word in self.patterns[:-1]:
            if not beyond.search(text):
                return word.findall(text)
        return self.patterns[-1][1].findall(text)

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        out = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.specials:
                out.append(self.specials[piece])
            elif piece:
                out += map(self.words.__getitem__, self.cuts(self.normal(piece)))
        return b"".join(out)

    def text(self, ids: bytes) -> str:
        """Texts of the tokens, joined by blanks, as the vocabulary has no decoder of its own."""
        tokens = self.tokens
        return " ".join([tokens[k] for k in np.frombuffer(ids, "<u4").tolist()])


def _free(columns: list[str], name: str) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "text", out: str = "encoded",
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the struct ``out``: n_tokens and ids (little-endian 32-bit integers).

    Special texts are tokens as they stand; what lies between them is composed, lower-cased and cut into words. Words of up
    to ``SHORT`` bytes are merged by the rank array, longer ones by a heap with the same result. Null and empty texts have no
    tokens, repeated rows and null ids stay, an empty table gives no rows, a column named like ``out`` is replaced. No
    shuffle; a task holds a batch, the vocabulary and at most ``MOST_WORDS`` words.
    """
    vocabulary = vocabulary or Vocabulary.read()
    sent = Shipped(docs.sparkSession, vocabulary)
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    fields = docs.select(*kept).schema.fields

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for whole in batches:
            for start in range(0, len(whole), _ROWS):
                batch = whole.slice(start, _ROWS)
                ids = [encoder.ids(t.as_py() or "") for t in batch.column(0)]
                made = pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                                  names=["n_tokens", "ids"])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names=[*kept, out])

    given = docs.select(F.col(text_col).alias(_free(kept, "text_in")), *kept)
    return given.mapInArrow(rows, StructType([*fields, StructField(out, ENCODED)]))


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "encoded.ids", out: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """``encoded`` (or its columns ``keep``) with the text of the ids in ``out``, special tokens included.

    Null ids give an empty text; an id outside the vocabulary fails the job. A column named like ``out`` is replaced.
    """
    vocabulary = vocabulary or Vocabulary.read()
    sent = Shipped(encoded.sparkSession, vocabulary)
    kept = [c for c in (encoded.columns if keep is None else keep) if c != out]
    fields = encoded.select(*kept).schema.fields

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for whole in batches:
            for start in range(0, len(whole), _ROWS):
                batch = whole.slice(start, _ROWS)
                texts = pa.array([encoder.text(x.as_py() or b"") for x in batch.column(0)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*kept, out])

    given = encoded.select(F.col(ids_col).alias(_free(kept, "ids_in")), *kept)
    return given.mapInArrow(rows, StructType([*fields, StructField(out, StringType())]))
