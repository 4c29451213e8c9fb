"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item, or the whole item if it has fewer. Winnowing keeps the
smallest hash of every run of span - k + 1 k-grams, in items and documents alike; whatever run of ``span`` words they
share, both keep the same smallest k-gram of it, so no shared span is missed. Kept document fingerprints that may be
among the kept test fingerprints are extended to all windows around them, and these are joined with the test windows
on the words themselves. Items shorter than ``span`` are looked up by all word runs of their length.

The bitmaps of test fingerprints and windows have a fixed size, so what is broadcast doesn't grow with the benchmark;
a fuller bitmap only lets more rows reach the join. Document rows are written once, with their few candidate windows.

Null texts have no words: no hits, no items. Rows of equal id are separate documents. An item without an id makes hits,
but isn't counted; rows of one item id are one item. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import ALNUM_LOWER, Words, bitmap_of, in_bitmap, signed, stage, tasks_for, text_slices, window_hashes, words_of

#: Words of a fingerprint.
K = 5
#: Bits of each bitmap (1 MB).
BITMAP_BITS = 23


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """Flags of the hashes that are the smallest of some run of ``run`` hashes."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(len(hashes), bool)
    least = hashes[:n].copy()
    for i in range(1, run):
        np.minimum(least, hashes[i : i + n], out=least)
    # A hash is kept if the largest of the minima of the runs that hold it is the hash itself.
    most = np.zeros(len(hashes), np.uint64)
    for i in range(run):
        np.maximum(most[i : i + n], least, out=most[i : i + n])
    return most == hashes


def _phrase(words: Words, start: int, size: int) -> str:
    return b" ".join([words.text(i) for i in range(start, start + size)]).decode("utf-8", "replace")


def _item_windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            out = []
            for first, end, data, offsets in text_slices(batch):
                words = words_of(data, offsets, ALNUM_LOWER)
                for row in range(first, end):
                    low, high = words.first[row - first], words.first[row - first + 1]
                    size = min(span, int(high - low))
                    if size:
                        hashes = signed(window_hashes(words.hashes[low:high], size)).tolist()
                        out += [(ids[row], size, _phrase(words, int(low) + i, size), h) for i, h in enumerate(hashes)]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                names=["item_id", "size", "words", "hash"],
            )

    return run


def _item_fingerprints(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch):
                words = words_of(data, offsets, ALNUM_LOWER)
                kept = []
                for low, high in zip(words.first[:-1], words.first[1:]):
                    grams = window_hashes(words.hashes[low:high], K)
                    kept.append(grams[winnow(grams, span - K + 1)])
                yield pa.record_batch({"hash": signed(np.concatenate(kept))})

    return run


def _document_hits(span: int, sizes: list[int], fingerprints, windows):
    """One row per document: (uid, doc_id, n_words, candidate windows)."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, end, data, offsets in text_slices(batch):
                words = words_of(data, offsets, ALNUM_LOWER)
                grams = window_hashes(words.hashes, K)
                candidates = []
                if span in sizes:
                    # A run of the whole slice may cross documents; that only keeps more fingerprints.
                    hits = np.flatnonzero(winnow(grams, span - K + 1))
                    hits = hits[in_bitmap(fingerprints.value, grams[hits])]
                    candidates.append((span, np.unique((hits[:, None] - np.arange(span - K + 1)).ravel())))
                candidates += [(n, np.arange(len(words.hashes))) for n in sizes if n < span]
                found: list[list] = [[] for _ in range(first, end)]
                for size, starts in candidates:
                    starts = starts[(starts >= 0) & (starts + size <= len(words.hashes))]
                    row = np.searchsorted(words.first, starts, side="right") - 1
                    inside = starts + size <= words.first[row + 1]
                    starts, row = starts[inside], row[inside]
                    maybe = in_bitmap(windows.value, window_hashes(words.hashes, size)[starts]) if len(starts) else np.zeros(0, bool)
                    for r, s in zip(row[maybe].tolist(), starts[maybe].tolist()):
                        found[r].append({"at": s - int(words.first[r]), "size": size, "words": _phrase(words, s, size)})
                yield pa.record_batch(
                    [pa.array(np.arange(uid, uid + end - first)), batch.column("doc_id").slice(first, end - first),
                     pa.array(np.diff(words.first).astype(np.int64)), pa.array(found, kind)],
                    names=["uid", "doc_id", "n_words", "hits"],
                )
                uid += end - first

    return run


_HITS = "uid long, doc_id long, n_words long, hits array<struct<at:int,size:int,words:string>>"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, span: int = 10) -> tuple[DataFrame, DataFrame]:
    """(documents, occurrences): rows (uid, doc_id, n_words) and (uid, at, size, item_id) of every window's occurrence."""
    if span <= K:
        raise ValueError(f"span must exceed the {K} words of a fingerprint")
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = stage(items.mapInArrow(_item_windows(span), "item_id string, size int, words string, hash long").distinct(), "windows", 4 * tasks_for(spark, 0))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``span`` rows
    kept = bitmap_of(items.mapInArrow(_item_fingerprints(span), "hash long"), "hash", BITMAP_BITS)
    broadcast = spark.sparkContext.broadcast
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stage(
        texts.mapInArrow(_document_hits(span, sizes, broadcast(kept), broadcast(bitmap_of(windows, "hash", BITMAP_BITS))), _HITS), "hits"
    )
    occurrences = (
        rows.where(F.size("hits") > 0).select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
        .join(windows.select("item_id", "size", "words"), ["size", "words"]).select("uid", "at", "size", "item_id")
    )
    return rows.select("uid", "doc_id", "n_words"), occurrences


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, occurrences = benchmark_hits(docs, benchmark, span)
    # Windows of a document in order: each adds the words that end beyond all before it.
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(acc["end"], s["at"]))).alias("n"),
            F.greatest(acc["end"], s["at"] + s["size"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("bigint"),
    )
    found = (
        occurrences.groupBy("uid")
        .agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.collect_set("item_id").alias("items"))
        .select("uid", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                F.array_join(F.array_sort("items"), ",").alias("items"))
    )
    return rows.join(found, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
