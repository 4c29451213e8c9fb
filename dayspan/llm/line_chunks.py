"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of a line and the line before it ends a chunk after one line in ``1 / density``. Boundaries
depend on nearby lines only, so an inserted line shifts no boundary beyond the next one. A chunk counts if it has several
lines. Chunk hashes are counted over all documents; only chunks whose hash occurs again are grouped by their bytes, and of
equal chunks the first (smallest doc_id, then place) stays.

A fixed-size bitmap of the repeated hashes rules out other chunks before their bytes are shuffled. Grouping is partially
aggregated, so a chunk that many documents share is one row of a task.

Null and empty texts have no chunks and stay as they are. Rows equal in id and text are one document: they are treated
alike, and none is the other's copy. A null id comes before all others. Blank lines belong to no chunk's bytes and go
with the lines before them. Extra columns pass through; only ``text`` changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayspan.llm.common import (
    _POWERS, bitmap_of, byte_class, in_bitmap, map_by_place, mix, signed, stage, text_slices, unused,
    words_of,
)

BITMAP_BITS = 24

_NOT_LINE_END = ~byte_class(b"\n")


def line_chunks(data: np.ndarray, offsets: np.ndarray, density: int):
    """(row, start, end, next start, hash) of the chunks that count; byte positions within the row.

    ``end`` is that of the last line, ``next start`` that of the next chunk's first line or of the text.
    """
    lines = words_of(data, offsets, _NOT_LINE_END, lower=False)
    n = len(lines.hashes)
    if not n:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    row = np.searchsorted(lines.first, np.arange(n), side="right") - 1
    before = np.concatenate([np.zeros(1, np.uint64), lines.hashes[:-1]])
    before[1:][row[1:] != row[:-1]] = 0
    rolled = mix(lines.hashes * np.uint64(3) + before)
    last = rolled % np.uint64(density) == 0
    last[:-1] |= row[1:] != row[:-1]
    last[-1] = True
    tail = np.flatnonzero(last)
    head = np.concatenate([[0], tail[:-1] + 1])
    up, down = _POWERS.upto(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.hashes * up[:n], dtype=np.uint64)])
    hashes = mix((total[tail + 1] - total[head]) * down[head] + (tail - head).astype(np.uint64))
    origin = offsets[row[head]]
    after = np.concatenate([lines.starts[head[1:]], offsets[-1:]])
    after = np.minimum(after, offsets[row[head] + 1])
    keep = np.flatnonzero(tail > head)
    return tuple(x[keep] for x in (row[head], lines.starts[head] - origin, lines.ends[tail] - origin, after - origin, hashes))


def _chunk_rows(density: int, repeated=None):
    """Hashes of all chunks or, given the bitmap of repeated ones, their places and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch):
                row, start, stop, after, hashes = line_chunks(data, offsets, density)
                if repeated is None:
                    yield pa.record_batch({"hash": signed(hashes)})
                    continue
                keep = in_bitmap(repeated.value, hashes)
                row, start, stop, after, hashes = (x[keep] for x in (row, start, stop, after, hashes))
                chunk = [data[offsets[r] + a : offsets[r] + b].tobytes() for r, a, b in zip(row, start, stop)]
                at = pa.array(row + first)
                yield pa.record_batch(
                    [batch.column("doc_id").take(at), batch.column("_text_hash").take(at), pa.array(start), pa.array(after),
                     pa.array(signed(hashes)), pa.array(chunk, pa.binary())],
                    names=["doc_id", "text_hash", "at", "after", "hash", "chunk"],
                )

    return run


def repeated_chunks(docs: DataFrame, density: int = 3) -> DataFrame:
    """Ranges to remove: (doc_id, text_hash, at, after) of every chunk that isn't the first of its bytes."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_text_hash"))
    hashes = texts.select("text").mapInArrow(_chunk_rows(density), "hash long")
    again = hashes.groupBy("hash").count().where("count > 1")
    repeated = docs.sparkSession.sparkContext.broadcast(bitmap_of(again, "hash", BITMAP_BITS))
    places = stage(
        texts.mapInArrow(
            _chunk_rows(density, repeated), "doc_id long, text_hash long, at long, after long, hash long, chunk binary"
        ),
        "chunks",
    )
    # Grouping by the bytes is the comparison; the hash comes first so that unequal keys part early.
    firsts = places.groupBy("hash", "chunk").agg(
        F.min(F.struct("doc_id", "text_hash", "at")).alias("first"), F.count("*").alias("n")
    ).where("n > 1").select(F.col("hash").alias("h"), F.col("chunk").alias("c"), "first")
    here = F.struct("doc_id", "text_hash", "at")
    return (
        places.join(firsts, (F.col("hash") == F.col("h")) & (F.col("chunk") == F.col("c")))
        .where(~here.eqNullSafe(F.col("first")))
        .select("doc_id", "text_hash", "at", "after")
    )


def _cut(names: list[str], place: int, count: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts, out = batch.column(place), batch.column(len(names)), []
            for text, ranges in zip(texts, cuts.to_pylist()):
                if not ranges:
                    out.append(text.as_py())
                    continue
                data, kept, at = text.as_py().encode(), [], 0
                for start, after in sorted((r["at"], r["after"]) for r in ranges):
                    kept.append(data[at:start])
                    at = max(at, after)
                out.append(b"".join([*kept, data[at:]]).decode().rstrip("\n"))
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(out, pa.string())
            removed = pa.array([len({(r["at"], r["after"]) for r in c}) if c else 0 for c in cuts.to_pylist()], pa.int64())
            yield pa.record_batch([*columns, removed], names=[*names, count])

    return run


def remove_repeated_chunks(docs: DataFrame, density: int = 3, count: str = "n_chunks_removed") -> DataFrame:
    """``docs`` with the repeated chunks cut from ``text``, and the number of them as the last column ``count``."""
    id_name, hash_name, cuts = (unused(name, docs.columns) for name in ("cut_id", "cut_hash", "cuts"))
    ranges = (
        repeated_chunks(docs, density)
        .groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "after")).alias(cuts))
        .withColumnsRenamed({"doc_id": id_name, "text_hash": hash_name})
    )
    own = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_name)) & (F.xxhash64("text") == F.col(hash_name))
    joined = docs.join(ranges, own, "left").drop(id_name, hash_name)
    schema = T.StructType([*docs.schema.fields, T.StructField(count, T.LongType())])
    return map_by_place(joined, _cut(docs.columns, docs.columns.index("text"), count), schema)
