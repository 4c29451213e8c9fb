"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Targets: weights 1, 2, 3, repeating over the sources in order of their names, share all words; a source gives at most
``most`` times its own words, and what is above goes to the others by weight. That is a water level: sorted by cap over
weight, the capped sources come first, so one running sum finds the level.

Schedule: a source needs ``ceil(target / block)`` slots, laid as cells of a grid of ``2 ** bits`` one source after another
(the cumulative weights). Slot n of the mix is the van der Corput point ``reverse_bits(n) / 2 ** bits``, so it falls into
one cell, and any stretch of the mix holds every source in about its share. The rank of a slot among those of its source
is a sum over the bits of its cell (``_rank``), which needs neither a sort nor a shuffle.

Blocks: the documents of a source are shuffled anew in each epoch (by a hash of seed, epoch and id) and laid end to end as
one stream of words, cut into blocks of equal length; block r meets the slot of rank r. The stream ends at the target, so
the words taken are exact. Positions in the stream are running sums in two levels (inside buckets of about the square root
of the source's documents, and over the buckets), so no task gets a whole source. A document of any length is cut into
pieces by arithmetic; text never travels.

Every row is a document. A null or empty text has size 0 and gives nothing. A null source is a source of its own, sorted
last. Rows equal in source, id (null or not) and size are numbered and shuffled apart; which of them has which number makes
no difference to the result. Without any words all targets are 0; an empty table gives an empty one. Only the three named
columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.llm.common import stage

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Cells of a source that one row of the slot generator stands for, and cells of a generating task.
_CHUNK, _CELLS = 1 << 13, 1 << 18


def source_targets(sizes: DataFrame, weights: int = 3, most: int = 3) -> DataFrame:
    """One row per source: source, n_docs, source_size, weight, target. ``sizes`` has source and size."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = (
        sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
        .withColumn("weight", ((F.row_number().over(by_name) - 1) % weights + 1).cast("bigint"))
    )
    cap = most * F.col("source_size")
    lowest = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = lowest.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    sources = sources.withColumns({
        "words": F.sum("source_size").over(everything),
        "weights": F.sum("weight").over(everything),
        "caps_before": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # The level if exactly the sources before this one are capped. The first that is not sets it; those after it get lower ones.
    level = (F.col("words") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before"))
    sources = sources.withColumn("level", F.when(level * F.col("weight") < cap, level))
    cap = cap.cast("double")
    target = F.least(cap, F.coalesce(F.max("level").over(everything) * F.col("weight"), cap))
    return sources.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def _grid(targets: DataFrame, block: int) -> DataFrame:
    """Adds number (of the source), goal, bits, block, first and end cell.

    The grid is the smallest power of two that holds all blocks of ``block`` words; then blocks are shortened until they
    fill it, but for one cell per source at most.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    goal = F.floor("target").cast("bigint")
    n = F.count(F.lit(1)).over(everything)
    needed = F.ceil(F.sum("goal").over(everything) / F.lit(block)) + n
    return (
        targets.withColumns({"number": F.row_number().over(by_name).cast("bigint"), "goal": goal})
        .withColumns({"bits": F.length(F.bin(needed)), "n": n, "words": F.sum("goal").over(everything)})
        .withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("words") / (F.expr("shiftleft(1L, bits)") - F.col("n")))))
        .withColumn("cells", F.ceil(F.col("goal") / F.col("block")))
        .withColumn("end", F.sum("cells").over(by_name))
        .withColumn("first", F.col("end") - F.col("cells"))
        .drop("n", "words", "cells")
    )


def _bit(cell: str, i: int) -> str:
    return f"(shiftright({cell}, {i}) & 1L)"


def _slot(cell: str, bits: int) -> Column:
    """Number of the slot whose van der Corput point is ``cell``: its bits reversed."""
    return F.expr(" + ".join(f"shiftleft({_bit(cell, i)}, {bits - 1 - i})" for i in range(bits)))


def _rank(cell: str, first: str, end: str, bits: int) -> Column:
    """Slots before that of ``cell`` whose cells lie from ``first`` up to ``end``.

    The earlier slots agree with this one above one of its set bits and lack that bit; the bits below are free. Reversed, a
    set bit i of the cell gives the cells r, r + 2^(i+1), r + 2 * 2^(i+1), ... with r the i lowest bits of the cell, and how
    many of them lie in an interval is a difference of two shifts.
    """

    def below(edge: str, i: int) -> str:
        return f"shiftright({edge} - ({cell} & {(1 << i) - 1}L) + {(2 << i) - 1}L, {i + 1})"

    return F.expr(" + ".join(f"{_bit(cell, i)} * ({below(end, i)} - {below(first, i)})" for i in range(bits)))


def slots(grid: DataFrame, bits: int) -> DataFrame:
    """Slots of the mix: number (of the source), rank and slot. Large sources are dealt out in chunks of cells.

    The number of tasks is given, because the chunks' own bytes say nothing of what they unfold to.
    """
    chunks = grid.where("end > first").select(
        "number", "first", "end", F.explode(F.sequence("first", F.col("end") - 1, F.lit(_CHUNK))).alias("at")
    ).repartition(max(1, (1 << bits) // _CELLS), "number", "at")
    cells = chunks.select(
        "number", "first", "end", F.explode(F.sequence("at", F.least(F.col("at") + _CHUNK, F.col("end")) - 1)).alias("cell")
    )
    return cells.select("number", _rank("cell", "first", "end", bits).alias("rank"), _slot("cell", bits).alias("slot"))


def _numbered(docs: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per document with the number of its source; rows equal in source, id and size are told apart by ``copy``."""
    groups = docs.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    return (
        groups.join(grid.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    )


def _stream(docs: DataFrame, grid: DataFrame, seed: int) -> DataFrame:
    """Documents with words, laid end to end: ``at`` is the place of the first word in the stream of the source."""
    epochs = F.ceil(F.try_divide(F.col("goal"), F.col("source_size")))
    buckets = F.ceil(F.sqrt("n_docs"))
    parts = [F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"), F.col("copy")]
    laid = (
        _numbered(docs, grid).where("size > 0 AND goal > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), epochs - 1)))
        .withColumn("key", F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])))
        # The bucket is the leading part of the key, so order by bucket and key is order by key.
        .withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * buckets, 32))
        .select("doc_id", "size", "copy", "number", "epoch", "bucket", "key", "goal", "block")
    )
    group = ["number", "epoch", "bucket"]
    inside = Window.partitionBy(*group).orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "copy")
    placed = laid.withColumn("ended", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    over = Window.partitionBy("number").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = laid.groupBy(*group).agg(F.sum("size").alias("words"))
    starts = totals.select(*group, (F.sum("words").over(over) - F.col("words")).alias("start"))
    at = F.col("start") + F.col("ended") - F.col("size")
    return placed.join(starts, group).select("number", "epoch", "doc_id", "size", "copy", at.alias("at"), "goal", "block")


def mix_schedule(docs: DataFrame, grid: DataFrame, bits: int, seed: int = 2024) -> DataFrame:
    """The mix: for every slot the pieces of documents that fill it.

    Columns slot, number (of the source), epoch, doc_id, size, copy, at (place in the source's stream), start (first word,
    within the document) and length. Ordered by slot and at, it is the training order.
    """
    pieces = (
        _stream(docs, grid, seed).withColumn("stop", F.least(F.col("at") + F.col("size"), F.col("goal"))).where("stop > at")
        .withColumn("rank", F.explode(F.sequence(F.expr("at div block"), F.expr("(stop - 1) div block"))))
        .withColumn("from", F.greatest(F.col("at"), F.col("rank") * F.col("block")))
        .withColumn("to", F.least(F.col("stop"), (F.col("rank") + 1) * F.col("block")))
        .select("number", "rank", "epoch", "doc_id", "size", "copy", F.col("from").alias("at"),
                (F.col("from") - F.col("at")).alias("start"), (F.col("to") - F.col("from")).alias("length"))
    )
    # The slots grow with the corpus, but the optimizer takes them for as few as the chunks: no broadcast.
    return pieces.join(slots(grid, bits).hint("merge"), ["number", "rank"]).drop("rank")


def prepare(documents: DataFrame, block: int = 1024, weights: int = 3, most: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, source and size of every document; the grid of sources; bits of the grid).

    Both tables are written: texts are read once, and what reaches the driver is one number.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    docs = stage(documents.select("doc_id", "source", size.alias("size")), "sizes")
    grid = stage(_grid(source_targets(docs, weights, most), block), "grid")
    row = grid.select("bits").first()
    return docs, grid, row["bits"] if row else 1


def mix_sources(documents: DataFrame, block: int = 1024, weights: int = 3, most: int = 3, seed: int = 2024) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes of the document, repeats counted)."""
    docs, grid, bits = prepare(documents, block, weights, most)
    key = ["number", "doc_id", "size", "copy"]
    none = _numbered(docs, grid).select(*key, F.lit(0).cast("bigint").alias("length"))
    taken = none.unionByName(mix_schedule(docs, grid, bits, seed).select(*key, "length")).groupBy(*key).agg(
        F.sum("length").alias("taken"))
    return taken.join(grid, "number").select("doc_id", "source", "size", "source_size", "target", "taken")
