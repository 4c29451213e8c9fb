"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (key, row number) and cut into parts of near equal bytes. The cuts are found by probing: each round
counts the exact bytes and rows below candidate boundaries in one partially aggregated pass over a narrow written table,
and narrows every boundary's bracket, until the bytes below it are within ``tolerance`` of its share or one row decides.
A boundary that falls into the rows of one key moves to the nearer end of them, so equal texts share a shard; only a key
larger than a shard's share is cut, by probing on by row number. Then all rows are exchanged once, by part.

A shard is a run of parts of bounded row counts, so a row's slot is the exact number of rows in the shard's earlier parts
plus its number within its part; no task holds a shard.

The driver sees sums per probe: at most ``PROBES`` per boundary. Null texts have size 16 and come first. Rows of equal key
stay together unless they alone exceed a shard; equal rows are told apart by their row number. Extra columns are not read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.llm.common import stage

PROBES = 63
#: Rows of a part, the unit of the final exchange.
PART_ROWS = 1_000_000


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def probes_upto(key: Column, number: Column, probes: list[tuple[int, int]]) -> Column:
    """How many of the ascending probes (key, row number) are not beyond a row: a binary search."""
    if not probes:
        return F.lit(0)
    keys, numbers = _longs([p[0] for p in probes]), _longs([p[1] for p in probes])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(probes).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        k, n = F.get(keys, at + step - 1), F.get(numbers, at + step - 1)
        return F.when((k < key) | ((k == key) & (n <= number)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def _between(low: int, high: int, count: int) -> list[int]:
    """Up to ``count`` whole numbers in (low, high), evenly spread."""
    return sorted({low + (high - low) * i // (count + 1) for i in range(1, count + 1)} - {low, high})


def find_splitters(rows: DataFrame, parts: int, tolerance: float, runs: int = 1) -> list[tuple[int, int]]:
    """Ascending (key, row number) splitters of ``rows`` (key, number, size): row r belongs to part i if i splitters aren't beyond it.

    Every ``runs`` parts are a shard. Only between parts of one shard, or in a key of more bytes than a shard's share, may a
    splitter fall into the rows of a key.
    """
    whole = rows.agg(F.sum("size").alias("b"), F.min("key").alias("lk"), F.max("key").alias("hk"), F.max("number").alias("n")).first()
    if not whole["b"] or parts < 2:
        return []
    total, last = int(whole["b"]), int(whole["n"])
    slack = tolerance * total / parts
    # A bracket holds (position, bytes below) on either side; a position is (key, row number) and -1 stands before all rows of a key.
    start, stop = ((int(whole["lk"]), -1), 0), ((int(whole["hk"]) + 1, -1), total)
    brackets = {i: (start, stop) for i in range(1, parts)}
    settled: dict[int, tuple[int, int]] = {}
    while brackets:
        probes: set[tuple[int, int]] = set()
        each = max(PROBES, 4096 // len(set(brackets.values())) if len(set(brackets.values())) == 1 else PROBES)
        for (low, _), (high, _) in set(brackets.values()):
            if high[0] - low[0] > 1 or high[0] > low[0] and low[1] == -1 and high[1] == -1 and high[0] - low[0] > 1:
                probes |= {(k, -1) for k in _between(low[0], high[0], each)}
            else:  # one key's rows: go on by row number
                upper = high[1] if high[0] == low[0] else last + 1
                probes |= {(low[0], n) for n in _between(low[1], upper, each)}
        ordered = sorted(probes)
        sums = {
            r["at"]: int(r["b"])
            for r in rows.groupBy(probes_upto(F.col("key"), F.col("number"), ordered).alias("at")).agg(F.sum("size").alias("b")).collect()
        }
        below, so_far = [], 0
        for i in range(len(ordered)):
            so_far += sums.get(i, 0)
            below.append(so_far)
        for i, (low, high) in list(brackets.items()):
            target = total * i // parts
            at = bisect.bisect_right(below, target)
            if at and ordered[at - 1] > low[0]:
                low = (ordered[at - 1], below[at - 1])
            if at < len(ordered) and ordered[at] < high[0]:
                high = (ordered[at], below[at])
            nearest = min((low, high), key=lambda side: abs(side[1] - target))
            tied = low[0][0] == high[0][0] or high[0] == (low[0][0] + 1, -1)
            closed = tied and (high[0][1] if high[0][0] == low[0][0] else last + 1) - low[0][1] <= 1
            one_key = low[0][1] == -1 and high[0] == (low[0][0] + 1, -1)
            whole_key = one_key and i % runs == 0 and high[1] - low[1] <= total * runs // parts
            if abs(nearest[1] - target) <= slack or closed or whole_key:
                settled[i] = nearest[0]
                del brackets[i]
            else:
                brackets[i] = (low, high)
    return sorted(settled[i] for i in range(1, parts))


def histogram_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.002, key: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``key`` is a bigint expression to sort by; by default a hash of the text, which brings equal texts together.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64("text") if key is None else key
    rows = stage(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(key, F.lit(-(1 << 63))).cast("bigint").alias("key"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "sizes",
    )
    # Keys leave room for a position beyond the largest.
    rows = rows.withColumn("key", F.least("key", F.lit((1 << 63) - 2)))
    runs = max(1, -(-rows.count() // (shards * PART_ROWS)))
    splitters = find_splitters(rows, shards * runs, tolerance / runs, runs)
    placed = rows.withColumn("part", probes_upto(F.col("key"), F.col("number"), splitters))
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    before = [sum(counts.get(p, 0) for p in range(i - i % runs, i)) for i in range(shards * runs)]
    order = Window.partitionBy("part").orderBy("key", "number")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.expr(f"cast(part div {runs} as int)").alias("shard"),
        (F.get(_longs(before), F.col("part")) + F.row_number().over(order) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
