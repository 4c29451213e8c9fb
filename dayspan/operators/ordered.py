"""Ordered scans (numbering, neighbours, fills) that do not depend on the size of a group.

A window partitioned by an id puts the whole id into one task. Who knows that ids are small (a calendar bounds them, or a
count did) says ``bounded_groups=True`` and gets that window, the best plan there is. Otherwise the rows are range-sorted by
(keys, order) into blocks of about equal size, whatever the distribution of the keys; each scan runs inside (block, key),
and the little that must cross a block border is carried by one summary row per (block, key).

Both ways give the same rows: ties of the order are broken by a hash of the whole row, so only rows that are equal
throughout are interchangeable. Neither runs a job when it is planned. The blocks are persisted on the executors' disks when
the result is first computed, because block numbers are used twice and range bounds come from a sample; a lost executor's
blocks are computed again from their lineage, under the same bounds. ``spark.catalog.clearCache()`` frees them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of input to a block, and the most blocks.
_BLOCK_BYTES, _MOST_BLOCKS = 128 << 20, 100_000

_BLOCK, _POS, _TIE = "_block", "_pos", "_tie"
_START, _END = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Scan:
    """One ordered computation, given as a window form and as its split form.

    ``backward`` scans look at later rows. They run over the reversed order, because
    Spark recomputes a frame that is open towards the end for every row, but extends
    one that is open towards the start.
    """

    value: Column
    over: Callable[[Column, WindowSpec], Column]
    summary: Callable[[Column, Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    combine: Callable[[Column, Column, Column, Column], Column]
    backward: bool = False


def running_sum(value: Column) -> Scan:
    """Sum over the rows up to and including this one."""
    return Scan(
        value,
        over=lambda v, w: F.sum(v).over(w.rowsBetween(_START, 0)),
        summary=lambda v, pos: F.sum(v),
        carry=lambda s, w: F.sum(s).over(w.rowsBetween(_START, -1)),
        combine=lambda inside, carried, first, last: F.when(
            inside.isNotNull() | carried.isNotNull(),
            F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0)),
        ),
    )


def running_count() -> Scan:
    """Row number in the given order."""
    return running_sum(F.lit(1).cast("bigint"))


def previous(value: Column) -> Scan:
    """Value of the row before."""
    return Scan(
        value,
        over=lambda v, w: F.lag(v).over(w),
        summary=lambda v, pos: F.max_by(v, pos),
        carry=lambda s, w: F.lag(s).over(w),
        combine=lambda inside, carried, first, last: F.when(first, carried).otherwise(inside),
    )


def following(value: Column) -> Scan:
    """Value of the row after."""
    return Scan(
        value,
        over=lambda v, w: F.lead(v).over(w),
        summary=lambda v, pos: F.min_by(v, pos),
        carry=lambda s, w: F.lead(s).over(w),
        combine=lambda inside, carried, first, last: F.when(last, carried).otherwise(inside),
    )


def group_total(value: Column) -> Scan:
    """Sum over all rows of the group."""
    return Scan(
        value,
        over=lambda v, w: F.sum(v).over(w.rowsBetween(_START, _END)),
        summary=lambda v, pos: F.sum(v),
        carry=lambda s, w: F.sum(s).over(w.rowsBetween(_START, _END)),
        combine=lambda inside, carried, first, last: carried,
    )


def known_before(value: Column) -> Scan:
    """Last non-null value above this row."""
    return Scan(
        value,
        over=lambda v, w: F.last(v, ignorenulls=True).over(w.rowsBetween(_START, -1)),
        summary=lambda v, pos: F.max_by(v, F.when(v.isNotNull(), pos)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(_START, -1)),
        combine=lambda inside, carried, first, last: F.coalesce(inside, carried),
    )


def known_after(value: Column) -> Scan:
    """First non-null value below this row."""
    return replace(known_before(value), summary=lambda v, pos: F.min_by(v, F.when(v.isNotNull(), pos)), backward=True)


def backward(scan: Scan) -> Scan:
    """The same from the last row to the first (for scans that don't depend on positions)."""
    return replace(scan, backward=True)


def last_known(value: Column) -> Scan:
    """Last non-null value up to this row (fill downward)."""
    return Scan(
        value,
        over=lambda v, w: F.last(v, ignorenulls=True).over(w.rowsBetween(_START, 0)),
        summary=lambda v, pos: F.max_by(v, F.when(v.isNotNull(), pos)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(_START, -1)),
        combine=lambda inside, carried, first, last: F.coalesce(inside, carried),
    )


def next_known(value: Column) -> Scan:
    """First non-null value from this row on (fill upward)."""
    return replace(
        last_known(value),
        summary=lambda v, pos: F.min_by(v, F.when(v.isNotNull(), pos)),
        backward=True,
    )


def smallest_from_here(value: Column) -> Scan:
    """Minimum over this row and all later ones."""
    return Scan(
        value,
        over=lambda v, w: F.min(v).over(w.rowsBetween(_START, 0)),
        summary=lambda v, pos: F.min(v),
        carry=lambda s, w: F.min(s).over(w.rowsBetween(_START, -1)),
        combine=lambda inside, carried, first, last: F.least(inside, carried),
        backward=True,
    )


def ascending(order: Sequence[str]) -> list[Column]:
    """Sort by the columns in turn, unknown values last."""
    return [F.col(c).asc_nulls_last() for c in order]


def _windows(keys: Sequence[str], order: Sequence[str]) -> dict[bool, WindowSpec]:
    """Window in the given order and, under ``True``, in the reversed one."""
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    reversed_order = [F.col(c).desc_nulls_first() for c in order]
    return {False: spec.orderBy(*ascending(order)), True: spec.orderBy(*reversed_order)}


def _tie_break(df: DataFrame) -> Column:
    """Hash of everything in a row that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not _holds_map(f.dataType)])


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, by the optimizer's statistics; tables of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(size for size in sizes if size < 1 << 60)


def block_count(df: DataFrame) -> int:
    """Blocks for a plan's rows: by the size of its input, at least the session's shuffle partitions."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(usual, -(-input_bytes(df) // _BLOCK_BYTES)), _MOST_BLOCKS)


class Ordered:
    """Rows in an order within keys, to which scans add columns one after another; all scans share the order.

    ``order`` is ascending, unknown values last. ``result`` gives the rows back without the helper columns.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], bounded_groups: bool = False):
        self.keys, self.bounded = list(keys), bounded_groups
        self.columns = list(df.columns)
        self.order = [*order, _TIE]
        df = df.withColumn(_TIE, _tie_break(df))
        if not bounded_groups:
            sort = [*[F.col(k).asc() for k in self.keys], *ascending(self.order)]
            placed = (
                df.repartitionByRange(block_count(df), *sort).sortWithinPartitions(*sort)
                .withColumn(_POS, F.monotonically_increasing_id()).withColumn(_BLOCK, F.shiftright(_POS, 33))
            )
            df = placed.persist(StorageLevel.DISK_ONLY)
        self.df = df

    def scan(self, scans: dict[str, Scan]) -> Ordered:
        """Add one column per scan."""
        if self.bounded:
            windows = _windows(self.keys, self.order)
            self.df = self.df.withColumns({name: s.over(s.value, windows[s.backward]) for name, s in scans.items()})
        else:
            self.df = self._split_scan(scans)
        self.columns += [name for name in scans if name not in self.columns]
        return self

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        """Add or replace columns computed within a row."""
        self.df = self.df.withColumns(columns)
        self.columns += [name for name in columns if name not in self.columns]
        return self

    def result(self, *without: str) -> DataFrame:
        return self.df.select(*[f"`{c}`" for c in self.columns if c not in without])

    def _split_scan(self, scans: dict[str, Scan]) -> DataFrame:
        blocks = self.df.withColumns({f"_v{i}": s.value for i, s in enumerate(scans.values())})
        parts = [_BLOCK, *self.keys]
        per_block = blocks.groupBy(*parts).agg(
            *[s.summary(F.col(f"_v{i}"), F.col(_POS)).alias(f"_s{i}") for i, s in enumerate(scans.values())]
        )
        # A key has at most one summary row per block, so this window is bounded by the number of blocks.
        across = _windows(self.keys, [_BLOCK])
        carried = per_block.select(
            *[F.col(p).alias(f"_k{i}") for i, p in enumerate(parts)],
            *[s.carry(F.col(f"_s{i}"), across[s.backward]).alias(f"_c{i}") for i, s in enumerate(scans.values())],
        )
        inside = _windows(parts, [_POS])
        local = blocks.withColumns(
            {
                **{f"_w{i}": s.over(F.col(f"_v{i}"), inside[s.backward]) for i, s in enumerate(scans.values())},
                "_first": F.lag(_POS).over(inside[False]).isNull(),
                "_last": F.lead(_POS).over(inside[False]).isNull(),
            }
        )
        same_group = reduce(
            lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_k{i}")) for i, p in enumerate(parts)]
        )
        joined = local.join(carried, same_group, "left")
        return joined.select(
            *[f"`{c}`" for c in self.df.columns if c not in scans],
            *[
                s.combine(F.col(f"_w{i}"), F.col(f"_c{i}"), F.col("_first"), F.col("_last")).alias(name)
                for i, (name, s) in enumerate(scans.items())
            ],
        )


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: dict[str, Scan],
                 bounded_groups: bool = False) -> DataFrame:
    """Add one column per scan, computed within ``keys`` in ascending ``order``, unknown values last.

    ``bounded_groups`` states that a whole group fits a task.
    """
    return Ordered(df, keys, order, bounded_groups).scan(scans).result()
