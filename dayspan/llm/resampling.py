"""Importance resampling of documents towards a target corpus by hashed n-grams.

Features of a text are runs of words joined by one space, each in the bucket of its CRC-32. The log ratio of a bucket's
smoothed shares in the target and in the documents is its gain; a document's weight is the mean gain of its features, and
Gumbel noise, fixed by the id, turns the highest scores into a draw without replacement.

Scanning: the distinct words a task has met form an Aho-Corasick automaton in which every word is bounded by the
delimiter on both sides, and carries its CRC and length as payload; a scan of the text emits the payloads word by word.
A longer run's CRC is composed from those of neighbours (CRC-32 is linear: append n bytes = shift by n zero bytes, then
xor), so no run is ever built as a string. A word that the automaton doesn't know shows as a gap between emitted words; its
payload is computed from its bytes, and it joins the automaton when that is next built anew, each time a quarter larger,
up to ``most_words`` words. So the dictionary is bounded and results don't depend on it.

Texts are read once: the buckets of a document, two bytes each, are written and serve both the counts and the scores.
Tasks send one count per bucket, the driver receives one per bucket (``buckets`` numbers, whatever the input). The draw
finds the lowest drawn score from counts per score (whole thousandths of a log, so some ten thousand distinct values at any
size), sorts only documents at or above it by ranges, and numbers them by counts per range; no task sees them all.

Every row is a document. A null or empty text, or one without words, has no features and weight 0 and is never drawn. A
null id counts as an empty one in the noise and sorts last. Rows with equal scores and ids follow each other by features
and weight; equal rows are interchangeable. Without target texts all counts of the target are 0. An empty table gives an
empty one. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import ALNUM_LOWER, release, stage, text_slices

_SPACE = 32
_BYTES = np.arange(256, dtype=np.uint8)
_LOWERED = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words in lower case, all others as the delimiter.
_PLAIN = np.where(ALNUM_LOWER[_LOWERED], _LOWERED, _SPACE).astype(np.uint8)

#: Longest word that joins the automaton, in bytes.
_LONGEST = 64


class Payloads:
    """CRC and length of the words of a task, emitted by an automaton that grows with the words met."""

    def __init__(self, most_words: int = 50_000):
        self.most_words = most_words
        self.automaton = ahocorasick.Automaton()
        self.waiting: dict[bytes, int] = {}

    def _grow(self) -> None:
        for word, payload in self.waiting.items():
            if len(self.automaton) < self.most_words and len(word) <= _LONGEST:
                self.automaton.add_word(f" {word.decode('latin-1')} ", payload)
        self.waiting.clear()
        self.automaton.make_automaton()

    def of(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Payloads (length << 32 | CRC) of the words of a text whose words are single-spaced or further apart."""
        out = np.full(len(starts), -1, np.int64)
        if len(self.automaton):
            emitted = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            # A match ends with the delimiter, which stands where the word's end (exclusive) is.
            out[np.searchsorted(ends, emitted[:, 0])] = emitted[:, 1]
        for i in np.flatnonzero(out < 0).tolist():
            word = text[starts[i] : ends[i]]
            out[i] = self.waiting[word] = len(word) << 32 | zlib.crc32(word)
        if len(self.waiting) > max(256, len(self.automaton) // 4):
            self._grow()
        return out


def _apply(operators: np.ndarray, which: np.ndarray | int, crcs: np.ndarray) -> np.ndarray:
    """Linear operators on 32 bits, given by the images of the bits, applied to CRCs."""
    out = np.zeros(crcs.shape, np.uint32)
    for bit in range(32):
        out ^= (crcs >> np.uint32(bit) & np.uint32(1)) * operators[which, bit]
    return out


def _byte_shift() -> np.ndarray:
    """Effect of one more zero byte on each bit of a CRC register (fixed value: the polynomial 0xEDB88320)."""
    images = []
    for bit in range(32):
        x = 1 << bit
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        images.append(x)
    return np.array([images], np.uint32)


def shifts(lengths: np.ndarray) -> np.ndarray:
    """Operators that append so many zero bytes, by repeated squaring."""
    out = np.tile((np.uint32(1) << np.arange(32, dtype=np.uint32)), (len(lengths), 1))
    power, left = _byte_shift(), lengths.copy()
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _apply(power, 0, out[odd])
        power, left = _apply(power, 0, power), left >> 1
    return out


def run_crcs(payloads: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each run length k, the CRCs of the runs of k words that start at word 0, 1, 2, ... (across texts too)."""
    words = (payloads & 0xFFFFFFFF).astype(np.uint32)
    runs = [words]
    if longest > 1:
        lengths, which = np.unique(payloads >> 32, return_inverse=True)
        append = shifts(lengths)
        space = np.full(len(words), zlib.crc32(b" "), np.uint32)
        spaced = _apply(append, which, space) ^ words
        append = shifts(lengths + 1)
        for k in range(1, longest):
            runs.append(_apply(append, which[k:], runs[-1][: max(len(words) - k, 0)]) ^ spaced[k:])
    return runs


def _buckets_of(batch: pa.RecordBatch, payloads: Payloads, runs: tuple[int, int], buckets: int) -> Iterator[pa.RecordBatch]:
    shortest, longest = runs
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    for first, end, data, offsets in text_slices(batch):
        rows = end - first
        lengths = np.diff(offsets)
        padded = np.full(len(data) + rows + 1, _SPACE, np.uint8)
        padded[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), lengths)] = _PLAIN[data]
        edges = np.flatnonzero(np.diff(padded != _SPACE))
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        crcs = run_crcs(payloads.of(padded.tobytes(), starts, ends), longest)
        bounds = np.searchsorted(starts, offsets + np.arange(rows + 1))
        words = np.diff(bounds)
        features = [np.maximum(words - k + 1, 0) for k in range(shortest, longest + 1)]
        size = np.concatenate([[0], np.cumsum(sum(features))])
        found = np.zeros(size[-1], kind)
        at = size[:-1].copy()
        for k, n in zip(range(shortest, longest + 1), features):
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found[np.repeat(at, n) + inside] = crcs[k - 1][np.repeat(bounds[:-1], n) + inside] % np.uint32(buckets)
            at += n
        starts_in_bytes = (size * found.itemsize).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(first, rows), pa.array(words.astype(np.int64)),
             pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(starts_in_bytes.tobytes()), pa.py_buffer(found.tobytes())])],
            names=["doc_id", "n_words", "found"],
        )


def hashed_features(docs: DataFrame, runs: tuple[int, int], buckets: int, most_words: int = 50_000) -> DataFrame:
    """doc_id, n_words and found: the buckets of all features, as one binary of 16-bit (32-bit above 65536) numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = Payloads(most_words)
        for batch in batches:
            yield from _buckets_of(batch, payloads, runs, buckets)

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words bigint, found binary")


def _found(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all rows, bounds of the rows)."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    array = batch.column("found").cast(pa.large_binary())
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(kind), (bounds - bounds[0]) // kind.itemsize


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_found(batch, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in features.select("found").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of every bucket, floored."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n)))) for s, t in pairs], np.int64)


def document_scores(features: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score."""
    kind = features.schema["doc_id"].dataType.simpleString()
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bounds = _found(batch, buckets)
            total = np.concatenate([[0], np.cumsum(gains[found])])
            n = np.diff(bounds)
            weight = (total[bounds[1:]] - total[bounds[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = features.mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", (F.col("weight") + noise).cast("bigint"))


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank: 1, 2, 3, ... over the drawn documents by score, ties to smaller ids; null for all others."""
    eligible = F.col("n_words") >= least_words
    per_score = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct score, see the module.
    reached = per_score.selectExpr("score", "sum(n) OVER (ORDER BY score DESC) - n AS above", "sum(n) OVER () * {p} DIV 100 AS most".format(p=percent))
    cut = reached.where("above < most").agg(F.min("score"), F.max("most")).first()
    none = F.lit(None).cast("bigint")
    if cut[0] is None:
        return scored.withColumn("rank", none)
    chosen = eligible & (F.col("score") >= cut[0])
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    placed = stage(
        scored.where(chosen).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.shiftright("place", 33)), "drawn")
    before = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).selectExpr("block", "sum(n) OVER (ORDER BY block) - n AS before")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.join(before, "block").withColumn("rank", F.when(rank <= cut[1], rank)).select(*scored.columns, "rank")
    return scored.where(~chosen).withColumn("rank", none).unionByName(ranked)


def resample(documents: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = 10_000, percent: int = 10,
             least_words: int = 20, seed: int = 2024, most_words: int = 50_000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document.

    ``documents`` has doc_id and text, ``target`` has text; ``runs`` are the shortest and longest run of words.
    """
    features = stage(hashed_features(documents, runs, buckets, most_words), "features")
    wanted = hashed_features(target.select(F.lit(0).cast("bigint").alias("doc_id"), "text"), runs, buckets, most_words)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    scored = stage(document_scores(features, gains, seed), "scores")
    release(features)
    return draw(scored, percent, least_words)
