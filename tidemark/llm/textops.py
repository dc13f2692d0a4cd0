"""Tokenising, hashing and block handling that the corpus operators share.

All functions work on UTF-8 bytes and numpy arrays inside Arrow batches; none keeps more than one
block of texts in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z only.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Lower-cases A-Z and turns every ASCII byte but letters and digits into a space.
FOLD_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Text bytes gathered before a block is worked on.
BLOCK_BYTES = 4 << 20


def fold_ascii(column: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. lower() gives just that where all is ASCII."""
    text = F.coalesce(column, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


class WordCache(dict):
    """word -> 64-bit hash; emptied when it holds too many words."""

    def __init__(self, seed: int = 0, most: int = 500_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lookup(table: dict, words: list[bytes], default: int = -1) -> np.ndarray:
    return np.fromiter(map(table.get, words, repeat(default)), np.int32, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): flips about half of the bits for each input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams(h: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of the n consecutive words that start at each position, for each n of ascending lengths."""
    out, n, acc = [], len(h), None
    for k in range(1, lengths[-1] + 1):
        size = max(0, n - k + 1)
        acc = h[:size].copy() if acc is None else acc[:size] * MULTIPLIER + h[k - 1 : k - 1 + size]
        if k in lengths:
            out.append(mix(acc))
    return out


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Joins small batches into tables of about ``most`` bytes of text; a longer text is a block of its own."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than lengths) and the owner of each element."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return offsets, np.repeat(np.arange(len(lengths)), lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
