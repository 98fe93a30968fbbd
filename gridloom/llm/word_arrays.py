"""Words of many texts at once, as arrays; and sets of n-grams as bitmaps of a bounded size.

Texts are read as the bytes that Arrow holds. Separators are single ASCII bytes, which in UTF-8 stand for themselves
alone, so words are cut without decoding. Equal words of one call share a code; the dictionary has each once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of bytes: within a word, between words, between pieces of a text (no phrase goes over those).
INSIDE, BETWEEN, BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A bitmap has so many bits an entry, at least and at most 2 to these powers in all (128 KB and 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 28
_ODD = np.uint64(0x9E3779B97F4A7C15)


def kinds(between: str, breaks: str = "") -> np.ndarray:
    """The kind of each byte, given the characters that separate words and those that separate pieces."""
    out = np.zeros(256, np.uint8)
    out[list(between.encode())] = BETWEEN
    if breaks:
        out[list(breaks.encode())] = BREAK
    return out


@dataclass
class Words:
    """Every word of some texts in order: its code, its text's row, and whether the next word follows in the piece."""

    code: np.ndarray
    row: np.ndarray
    follows: np.ndarray
    dictionary: pa.Array


def words_of(column: pa.Array, kind: np.ndarray) -> Words:
    """Words of a column of texts (null: none), A-Z in lower case."""
    held = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    of = kind[data]
    inside = of == INSIDE
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data) + 1, bool)
    before[1:] = ~inside
    starts = np.flatnonzero(inside & (before[:-1] | edge[:-1]))
    stops = np.flatnonzero(inside & (np.append(before[2:], True)[: len(data)] | edge[1:])) + 1
    packed, ends = _LOWER[data[inside]], np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    coded = cut.dictionary_encode()
    row = np.searchsorted(offsets, starts, side="right") - 1
    follows = np.zeros(len(starts), bool)
    if len(starts):
        piece = np.cumsum(of == BREAK, dtype=np.int64)[starts]
        follows[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return Words(coded.indices.to_numpy().astype(np.int64), row, follows, coded.dictionary)


def hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def chained(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits of a sequence, from those of all but its last word and those of the last."""
    x = (prefix ^ (prefix >> np.uint64(29))) * _ODD + word
    return x ^ (x >> np.uint64(32))


class Bitmap:
    """A set of 64-bit values, each as one bit. What is in the set is always found; few others are."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.bits = bits
        self.cells = np.zeros(1 << (bits - 3), np.uint8)
        for part, data in parts.items():
            self.cells[part * 4096 : part * 4096 + len(data)] = np.frombuffer(data, np.uint8)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = places(values, self.bits)
        return (self.cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def places(values: np.ndarray, bits: int) -> np.ndarray:
    """Each value's bit."""
    return ((values * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(grams: DataFrame, hashed, size: int, most_bits: int = MOST_BITS) -> Bitmap:
    """The bitmap of a table's rows; ``hashed(batch)`` gives 64 bits of each, ``size`` is their number.

    Bits are set in the cluster, part by part; what comes to the driver is the bitmap, whose size is bounded.
    """
    bits = min(max(LEAST_BITS, (BITS_EACH * max(1, size)).bit_length()), most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(places(hashed(batch), bits)), pa.int64())], names=["at"])

    # bitmap_bucket_number counts from 1 for positive positions, bitmap_bit_position is within a bucket
    placed = grams.mapInArrow(run, "at long").selectExpr("at div 32768 AS part", "at % 32768 AS bit")
    parts = placed.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("data")).collect()
    return Bitmap(bits, {r.part: bytes(r.data) for r in parts})
