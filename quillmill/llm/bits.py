"""A filter of bounded size for keys that are joined later on: what is in it may be a key, what is not is none."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits per key, and the exponent of the most bits in all (16 MB); beyond, more passes that is no key.
PER_KEY, MOST_BITS = 128, 27
_BUCKET = 1 << 15 >> 3  # bytes of a bucket of the JVM's bitmap aggregate


def build(keys: DataFrame, first, second) -> np.ndarray:
    """Two bits per key, at the places that two integer columns of `keys` give, put together on the executors."""
    count = keys.count()
    bits = min(MOST_BITS, max(16, int(PER_KEY * count).bit_length()))
    # bit positions of the aggregate count from 1
    slots = keys.select(F.explode(F.array(*[c.bitwiseAND((1 << bits) - 1) + 1 for c in (first, second)])).alias("slot"))
    per = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for r in per.toLocalIterator():
        at = (r.bucket - 1) * _BUCKET
        out[at : at + _BUCKET] = np.frombuffer(bytes(r.bits), dtype=np.uint8)[: len(out) - at]
    return out


def found(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the places have their bit set."""
    slot = place & np.uint64(len(table) * 8 - 1)
    return np.flatnonzero(table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


def word_filter(words: DataFrame, name: str) -> np.ndarray:
    """A filter of the strings in a column."""
    keys = words.select(name).distinct()
    return build(keys, F.crc32(name), F.crc32(F.concat(F.lit("#"), F.col(name))))


def has_word(table: np.ndarray, word: str) -> bool:
    mask = len(table) * 8 - 1
    data = word.encode("utf-8", "replace")
    for b in (data, b"#" + data):
        slot = zlib.crc32(b) & mask
        if not table[slot >> 3] >> (slot & 7) & 1:
            return False
    return True
