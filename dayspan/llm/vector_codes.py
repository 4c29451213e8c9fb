"""Compression of vectors to codes (product quantisation) with exact integer arithmetic.

Components become integers floor(256 x). A vector is cut into equal parts; each part position has a codebook that starts
as that part of the first vectors and is refined by rounds of nearest-entry assignment and floored means.

Nearest entries are found in the Walsh-Hadamard domain: parts and entries are padded with zeros to a power of two, p, and
transformed by additions and subtractions only. The transform H has H'H = p I, so squared differences of transformed
values add up to exactly p times the squared distance. They are accumulated in sequency order (coefficients with few sign
changes first, where smooth vectors have their weight), and a partial sum is a lower bound: an entry is dropped as soon as
its sum exceeds the full sum of the entry that was nearest after the first coefficient. Everything is integer, so ties are
true ties and go to the lower index.

A round is one narrow pass: each task adds up its parts by entry and sends one row per part position and entry; the
codebooks (entries x dimension integers, whatever the table's size) are all that reaches the driver.

Rows are dropped if the vector is null or a component is null, NaN, infinite or beyond 1e25 (its distances fit no bigint).
Vectors whose length isn't a multiple of the number of parts, or that are shorter than others, are padded with zeros at
their end. Integers too large for 64-bit sums are computed with Python's unbounded ones; an error beyond a bigint is null.
Repeated ids are rows of their own; the codebooks start from the lowest ids, null ids last, equal ids by their vectors.
With fewer rows than entries the codebooks are shorter; an empty table gives an empty result. Only the named columns are
read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import stage

#: Largest magnitude of a component that is read as a number.
LARGEST = 1e25


def hadamard(size: int) -> np.ndarray:
    """Walsh-Hadamard matrix of a power of two, rows in sequency order (0, 1, 2, ... sign changes)."""
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort((np.diff(matrix, axis=1) != 0).sum(1), kind="stable")]


def transform(parts: np.ndarray) -> np.ndarray:
    """Coefficients of integer parts (last axis), padded with zeros to a power of two."""
    width = parts.shape[-1]
    size = 1 << max(width - 1, 0).bit_length()
    return parts @ hadamard(size)[:, :width].T.astype(parts.dtype)


def fits(largest: int, width: int) -> bool:
    """Whether sums of squared coefficient differences stay within 62 bits."""
    size = 1 << max(width - 1, 0).bit_length()
    return 4 * size**3 * largest**2 < 1 << 62


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every part (the lower one on a tie) and the squared distance."""
    a, b = transform(parts), transform(entries)
    n, k, size = len(a), len(b), a.shape[1]
    everyone = np.arange(n)
    sums = (a[:, :1] - b[:, 0]) ** 2
    likely = sums.argmin(1) if sums.dtype != object else np.array([min(range(k), key=row.__getitem__) for row in sums], int)
    bound = ((a - b[likely]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    left = sums[row, entry]
    for c in range(1, size):
        left = left + (a[row, c] - b[entry, c]) ** 2
        stay = left <= bound[row]
        row, entry, left = row[stay], entry[stay], left[stay]
    # The likely entry itself always survives. Survivors are in order of row and entry, and the first of the least is taken.
    first = np.searchsorted(row, everyone)
    least = np.minimum.reduceat(left, first) if n else left
    best = np.flatnonzero(left == least[row])
    chosen = best[np.searchsorted(row[best], everyone)]
    return entry[chosen], least // size


def integers(vectors: pa.Array, parts: int, width: int) -> np.ndarray:
    """Integer components of vectors without nulls, shape (rows, parts, width), as int64 or as Python integers."""
    array = vectors.cast(pa.large_list(pa.float64()))
    offsets = array.offsets.to_numpy()
    values = np.floor(256 * array.values.to_numpy(zero_copy_only=False))
    lengths = np.diff(offsets)
    kept = np.arange(parts * width) < lengths[:, None]
    if fits(int(np.abs(values[offsets[0] : offsets[-1]]).max(initial=0)) + 1, width):
        out = np.zeros(kept.shape, np.int64)
        out[kept] = values[offsets[0] : offsets[-1]].astype(np.int64)
    else:
        out = np.zeros(kept.shape, object)
        out[kept] = [int(v) for v in values[offsets[0] : offsets[-1]]]
    return out.reshape(-1, parts, width)


def _matching(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and codebooks as one kind of integer that is large enough for both."""
    exact = x.dtype != object and fits(max((abs(int(v)) for v in (book.min(initial=0), book.max(initial=0))), default=0), x.shape[2])
    return (x, book.astype(np.int64)) if exact else (x.astype(object), book.astype(object))


def _assign(book: np.ndarray, parts: int, width: int) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    def assign(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, entries = _matching(integers(vectors, parts, width), book)
        codes, errors = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), x.dtype)
        for p in range(parts):
            codes[:, p], errors[:, p] = nearest(x[:, p], entries[p])
        return x, codes, errors

    return assign


def refine(kept: DataFrame, book: np.ndarray, parts: int, width: int) -> np.ndarray:
    """One round: assign every part, then move every used entry to the floored mean of its parts."""
    entries, assign = book.shape[1], _assign(book, parts, width)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python integers: the sums of a task may outgrow 64 bits.
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), object)
        for batch in batches:
            x, codes, _ = assign(batch.column(0))
            at = (codes + np.arange(parts) * entries).ravel()
            part_sums = np.zeros(sums.shape, x.dtype)
            np.add.at(part_sums, at, x.reshape(-1, width))
            counts += np.bincount(at, minlength=len(counts))
            sums += part_sums.astype(object)
        used = np.flatnonzero(counts)
        columns = [sums[used, i].tolist() for i in range(width)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), *[pa.array(c, pa.decimal128(38, 0)) for c in columns]],
            names=["at", "n", *[f"s{i}" for i in range(width)]],
        )

    names = [f"s{i}" for i in range(width)]
    schema = "at bigint, n bigint" + "".join(f", {s} decimal(38,0)" for s in names)
    summed = kept.select("vector").mapInArrow(add_up, schema).groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
    out = book.astype(object).reshape(parts * entries, width)
    for row in summed.collect():
        out[row["at"]] = [int(row[s]) // row["n"] for s in names]
    return out.reshape(book.shape)


def train_codebooks(kept: DataFrame, parts: int, entries: int, rounds: int, width: int) -> np.ndarray:
    """Codebooks as integers of shape (parts, entries, width)."""
    start = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    x = integers(start.column(0).combine_chunks(), parts, width)
    book = np.ascontiguousarray(np.swapaxes(x, 0, 1))
    for _ in range(rounds):
        book = refine(kept, book, parts, width)
    return book


def compress_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = 16, entries: int = 64,
                     rounds: int = 2) -> DataFrame:
    """id, code (two hex digits per part), error, label_error (errors of all rows of the label) and codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    vector = F.col(vector_col).cast("array<double>")
    usable = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))
    kept = df.select(F.col(id_col).alias("id"), vector.alias("vector"), F.col(label_col).alias("label")).where(
        F.col("vector").isNotNull() & usable)
    length = kept.agg(F.max(F.size("vector"))).first()[0]
    width = max(1, -(-(length or 0) // parts))
    book = train_codebooks(kept, parts, entries, rounds, width) if length is not None else np.zeros((parts, 0, width), np.int64)
    digest = hashlib.sha256(",".join(str(int(v)) for v in book.ravel()).encode()).hexdigest()
    assign = _assign(book, parts, width)
    id_type, label_type = kept.schema["id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, errors = assign(batch.column("vector"))
            text = codes.astype(np.uint8).tobytes().hex()
            total = [int(e) for e in errors.sum(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]),
                 pa.array([e if e < 1 << 63 else None for e in total], pa.int64()), batch.column("label")],
                names=["id", "code", "error", "label"],
            )

    # Written: the codes are read for the sums by label and for the result.
    codes = stage(kept.mapInArrow(encode, f"id {id_type}, code string, error bigint, label {label_type}"), "codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
