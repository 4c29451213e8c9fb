"""Helpers shared by the document operators: written stages, words of Arrow batches, fixed-size bitmaps.

Words are hashed a whole Arrow batch at a time: a polynomial over the bytes whose partial
sums give the hash of every word by one subtraction, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayspan.session import release, stage

__all__ = [
    "Words", "bitmap_of", "in_bitmap", "map_by_place", "mix", "release", "signed", "stage", "tasks_for", "text_slices", "unused", "window_hashes", "words_of",
]

#: Text of one numpy step; a longer document is a step of its own. A step takes some fifty times its bytes for a while.
STEP_BYTES = 1 << 17

#: Rows of a few numbers that one task writes before another is worth its file.
ROWS_A_TASK = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)


class _Powers:
    """Powers of a multiplier and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
                    for base in (_ODD, _INVERSE)
                )
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about STEP_BYTES: (first row, end row, bytes, row offsets into the bytes).

    A null text has no bytes.
    """
    array = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def byte_class(pattern_bytes: bytes) -> np.ndarray:
    """Table of 256 flags with the given bytes set."""
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern_bytes, np.uint8)] = True
    return table


#: Words are [^\x20\x09-\x0D]+, that is, everything but ASCII white space.
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text, that is, 0-9, a-z and all beyond ASCII.
ALNUM_LOWER = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """Words of a run of rows: hash, byte range and the index of each row's first word."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, data: np.ndarray):
        self.hashes, self.starts, self.ends, self.first, self.data = hashes, starts, ends, first, data

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """Words (runs of ``inside`` bytes) of every row; a word never crosses a row's border."""
    data = _LOWER[data] if lower else data
    n = len(data)
    flag = inside[data]
    begins, closes = flag.copy(), flag.copy()
    begins[1:] &= ~flag[:-1]
    closes[:-1] &= ~flag[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < n)]
    begins[border] = flag[border]
    closes[border - 1] = flag[border - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    with np.errstate(over="ignore"):
        up, down = _POWERS.upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` consecutive words (none if there are fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = total * _ODD + words[i : i + n]
        return mix(total + np.uint64(size))


def bitmap_of(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """Bitmap of ``2 ** bits`` bits with a bit set for every bigint key: at most ``2 ** (bits - 6)`` rows reach the driver.

    Its size doesn't depend on the number of keys. A set bit is no proof, an unset one is; more keys
    only mean that fewer rows are ruled out early.
    """
    at = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        keys.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Flags of the uint64 keys that may be in the bitmap."""
    at = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (keys & np.uint64(63))) & np.uint64(1) != 0


def map_by_place(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` of a function that finds its columns by position, whatever their names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that write so many rows of a few numbers: all cores, and more of them from ROWS_A_TASK rows each."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def unused(name: str, columns: Sequence[str]) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
