"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Two sets link if their Jaccard similarity is at
least ``percent`` / 100. Sizes are cut into bands; within a band the similarity bounds the number of differing
elements by some k. A hash cuts the domain of elements into n1 partitions of n2 parts each, and every choice of c
parts within one partition gives one signature, the hash of the set's elements in those parts. An element spoils the
choices that hold its part; it takes n2 - c + 1 spoiled parts to leave a partition no choice. As soon as
n1 * (n2 - c + 1) > k, two linked sets agree on a choice and share its signature. Small sets take every two of three
parts (``SUBSETS``): more elements to a signature, so fewer that are shared by chance. Larger ones, which give most of
the signatures, take single parts of two, the scheme with the fewest.

That argument may rest on a choice that is empty in both sets, and signatures of nothing are not emitted. So a set
counts how many differing elements could empty or spoil all of its choices: of a partition with m filled parts, the
lesser of m and n2 - c + 1. If k are enough, it also gives
signatures under a domain cut ``FINER`` times as fine, and if those don't suffice either, one for every element.
Two linked sets both do so, or one of them is covered by the coarser cut; no link is lost.

The flow:

1. every document gets (size, 128-bit digest of its set); equal sets are one class, represented by its smallest id;
2. (signature, class) pairs are made once, sorted by signature in one exchange, and read as a stream; a signature of one
   class is finished;
3. classes that share a signature form a family under the smallest of them, so a family is named once, however many
   signatures its members share;
4. families are compared in blocks of bounded size, where every pair of blocks is a group, by sketches: the numbers of
   elements in equal ranges of the hash, more ranges for larger sets. The sum of their differences is a lower bound of the
   number of differing elements, so it leaves few pairs, whose components hold every link. A class is in many families
   but in one component;
5. components are cut into blocks like families; only now sets are sent, once for each block of their component, and
   exact intersections come from a product of 0/1 matrices over the elements that occur twice. Only a spanning forest
   of the verified links leaves the task;
6. components by alternating star contractions, each round written to the shared folder.

Nulls and empty texts have empty sets and link with nothing. Rows of equal id and text are one document twice: each
gets a result row. A null id gets a null component unless its set is linked to one with an id; ties don't exist, as
only minima are taken. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import (
    NOT_SPACE, bitmap_of, in_bitmap, mix, release, signed, stage, tasks_for, text_slices, window_hashes, words_of,
)

#: Parts of a partition and parts of a choice: up to so many differing elements, and beyond.
SUBSETS_UPTO, SUBSETS, SINGLES = 30, (3, 2), (2, 1)
#: How much finer the domain is cut for sets that the first cut doesn't cover.
FINER = 8
#: Bits of the bitmap that rules out documents before their sets are sent (8 MB, whatever their number).
BITMAP_BITS = 26
#: Ranges of a sketch are two to the power of these at least and at most. A count beyond 255 is kept as 255, which only makes
#: the lower bound lower. Too few ranges for a large set would let unrelated ones pass.
LEAST_BITS, MOST_BITS = 7, 14
#: Bounds of a block of a family: documents and elements.
BLOCK_DOCS, BLOCK_ELEMENTS = 512, 1 << 20


class Sets:
    """Sets of a run of rows: distinct shingle hashes, ascending within a row, and each row's range of them.

    A text of fewer words than a shingle has one element.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int):
        words = words_of(data, offsets, NOT_SPACE)
        low, high = words.first[:-1], words.first[1:]
        windows = window_hashes(words.hashes, shingle)
        counts = np.where(high - low >= shingle, high - low - shingle + 1, (high > low).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        elements = np.zeros(bounds[-1], np.uint64)
        for i, (a, b, n) in enumerate(zip(low.tolist(), high.tolist(), counts.tolist())):
            if n:
                own = elements[bounds[i] : bounds[i + 1]]
                own[:] = windows[a : a + n] if b - a >= shingle else window_hashes(words.hashes[a:b], b - a)
                own.sort()
        fresh = np.ones(len(elements), bool)
        fresh[1:] = elements[1:] != elements[:-1]
        fresh[bounds[:-1][counts > 0]] = True
        self.elements = elements[fresh]
        self.bounds = np.concatenate([[0], np.cumsum(fresh)])[bounds]
        self.sizes = np.diff(self.bounds)
        #: Sums of scrambled elements up to a position: the sum over any run is one subtraction.
        self.totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.elements), dtype=np.uint64)])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of every set."""
        other = np.cumsum(self.elements * (self.elements ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)
        other = np.concatenate([np.zeros(1, np.uint64), other])
        a, b = (t[self.bounds[1:]] - t[self.bounds[:-1]] for t in (self.totals, other))
        return signed(a), signed(b)

    def sketches(self) -> list[bytes]:
        """Numbers of elements in equal ranges of the hash, a string of bytes for every set: about eight elements to a range."""
        bits = np.ceil(np.log2(np.maximum(self.sizes / 8, 1))).astype(np.int64).clip(LEAST_BITS, MOST_BITS)
        ends = np.cumsum(1 << bits)
        starts = ends - (1 << bits)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        bucket = (self.elements >> (64 - bits[row]).astype(np.uint64)).astype(np.int64)
        counts = np.bincount(starts[row] + bucket, minlength=int(ends[-1]) if len(ends) else 0)
        counts = np.minimum(counts, 255).astype(np.uint8)
        return [counts[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]

    def of(self, row: int) -> np.ndarray:
        return self.elements[self.bounds[row] : self.bounds[row + 1]]


@lru_cache(maxsize=64)
def size_bands(percent: int, upto: int) -> list[tuple[int, int, int]]:
    """(smallest, largest, k) of each band up to a size.

    A pair belongs to the band of its smaller set, so its larger one has at most ``largest * 100 / percent`` elements.
    Of a + b elements in two sets of similarity p at most (a + b) * (1 - p) / (1 + p) differ.
    """
    bands, low = [], 1
    while low <= upto:
        high = max(low, (low * 10_000 - 1) // (percent * percent))
        bands.append((low, high, (high + high * 100 // percent) * (100 - percent) // (100 + percent)))
        low = high + 1
    return bands


def signatures(sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all sets, each as one of the smaller and as one of the larger sets of a pair."""
    rows, found = [], []
    sizes = sets.sizes
    for number, (low, high, k) in enumerate(size_bands(percent, 1 << int(sizes.max(initial=1)).bit_length())):
        smaller = (low <= sizes) & (sizes <= high)
        larger = (sizes > high) & (-(-sizes * percent // 100) <= high)
        left = np.flatnonzero(smaller | larger) if k else []  # k = 0: only equal sets link, and those are one class
        shape = SUBSETS if k <= SUBSETS_UPTO else SINGLES
        for level, n1 in enumerate((-(-(k * 6 // 5 + 3) // (shape[0] - shape[1] + 1)), FINER * (k + 1))):
            if len(left):
                row, value, spoilt_by = _cut(sets, left, n1, *shape)
                rows.append(row)
                found.append(mix(value + np.uint64((number * 4 + level) * 0x2545F4914F6CDD1D % (1 << 64))))
                left = left[spoilt_by <= k]
        if len(left):
            row, at = _spread(sets, left)
            rows.append(row)
            found.append(mix(sets.elements[at] + np.uint64((number * 4 + 2) * 0x2545F4914F6CDD1D % (1 << 64))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(found)


def _spread(sets: Sets, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all elements of the given rows."""
    lengths = sets.sizes[rows]
    before = np.cumsum(lengths) - lengths
    return np.repeat(rows, lengths), np.repeat(sets.bounds[rows] - before, lengths) + np.arange(lengths.sum())


def _cut(sets: Sets, rows: np.ndarray, n1: int, n2: int, chosen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Under one cut of the domain: (row, hash) of each choice that isn't empty, and for each row how many elements spoil all.

    Elements are ascending hashes, and equal ranges of the hash are the parts, so each part is one run.
    """
    row, at = _spread(sets, rows)
    part = (sets.elements[at] >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)
    heads = np.flatnonzero((part[1:] != part[:-1]) | (row[1:] != row[:-1])) + 1
    heads = np.concatenate([[0], heads])
    tails = np.concatenate([heads[1:], [len(at)]]) - 1
    total = sets.totals[at[tails] + 1] - sets.totals[at[heads]]
    row, part = row[heads], part[heads].astype(np.int64)
    partition = part // n2
    first = np.concatenate([[True], (partition[1:] != partition[:-1]) | (row[1:] != row[:-1])])
    group = np.cumsum(first) - 1
    filled = np.bincount(group)
    cost = np.minimum(filled, n2 - chosen + 1)
    spoilt_by = np.bincount(np.searchsorted(rows, row[first]), weights=cost, minlength=len(rows)).astype(np.int64)
    if chosen == 1:
        return row, mix(total) ^ mix((part + 1).astype(np.uint64)), spoilt_by
    sums, used = np.zeros((len(filled), n2), np.uint64), np.zeros((len(filled), n2), bool)
    sums[group, part % n2], used[group, part % n2] = total, True
    out_rows, out = [], []
    for number, parts in enumerate(combinations(range(n2), chosen)):
        held = used[:, parts].any(axis=1)
        name = (partition[first][held] * comb(n2, chosen) + number + 1).astype(np.uint64)
        out_rows.append(row[first][held])
        out.append(mix(sums[held][:, parts].sum(axis=1, dtype=np.uint64)) ^ mix(name))
    return np.concatenate(out_rows), np.concatenate(out), spoilt_by


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int, Sets]]:
    for first, end, data, offsets in text_slices(batch):
        yield first, end, Sets(data, offsets, shingle)


def _digests(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, sets in _sets(batch, shingle):
                a, b = sets.digests()
                ids = batch.column("doc_id").slice(first, end - first)
                sketches = pa.array(sets.sketches(), pa.binary())
                yield pa.record_batch(
                    [ids, pa.array(sets.sizes), pa.array(a), pa.array(b), sketches], names=["doc_id", "size", "a", "b", "sketch"]
                )

    return run


def _signature_rows(shingle: int, percent: int):
    """Signatures of every class that a task meets; copies within a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets in _sets(batch, shingle):
                rows, found = signatures(sets, percent)
                names, _ = sets.digests()
                fresh = np.ones(len(names), bool)
                for i, name in enumerate(names.tolist()):
                    fresh[i] = name not in seen
                    seen.add(name)
                if len(seen) > 1_000_000:
                    seen.clear()
                keep = fresh[rows]
                yield pa.record_batch({"signature": signed(found[keep]), "class": names[rows[keep]]})

    return run


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, class) of the classes that share a signature with a smaller one, from rows sorted by (signature, class)."""
    last = leader = None
    for batch in batches:
        signature, own = (batch.column(c).to_numpy() for c in ("signature", "class"))
        if not len(own):
            continue
        head = np.concatenate([[signature[0] != last], signature[1:] != signature[:-1]])
        leaders = own[head] if head[0] else np.concatenate([[leader], own[head]])
        leading = leaders[np.cumsum(head) - int(head[0])]
        pairs = np.unique(np.stack([leading, own], axis=1)[own != leading], axis=0)
        yield pa.record_batch({"leader": pairs[:, 0], "class": pairs[:, 1]})
        last, leader = signature[-1], leading[-1]


def _elements(shingle: int, wanted):
    """Sets of the documents whose id may be that of a representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(in_bitmap(wanted.value, ids.view(np.uint64))))
            for first, end, sets in _sets(batch, shingle):
                contents = pa.array([sets.of(i).tobytes() for i in range(end - first)], pa.binary())
                yield pa.record_batch(
                    [pa.array(sets.digests()[0]), batch.column("doc_id").slice(first, end - first), contents],
                    names=["class", "id", "elements"],
                )

    return run


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among the sets (each of distinct hashes), as pairs of positions."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.full(len(values), -1)
    number[counts > 1] = np.arange((counts > 1).sum())
    columns, rows = number[inverse], np.repeat(np.arange(len(sets)), sizes)
    columns, rows = columns[columns >= 0], rows[columns >= 0]
    order = np.argsort(columns, kind="stable")
    columns, rows = columns[order], rows[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((counts > 1).sum()), 2048):
        own = slice(*np.searchsorted(columns, [low, low + 2048]))
        part = np.zeros((len(sets), 2048), np.float32)
        part[rows[own], columns[own] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = 100 * common >= percent * union
    seen, out = np.zeros(len(sets), bool), []
    for root in range(len(sets)):
        if not seen[root]:
            seen[root] = True
            front = np.array([root])
            while len(front):
                reached = linked[front].any(axis=0) & ~seen
                seen |= reached
                front = np.flatnonzero(reached)
                out += [(root, int(i)) for i in front]
    return out


def alike(sketches: Sequence[bytes]) -> np.ndarray:
    """Sketches as rows of the coarsest one's width: neighbouring ranges of finer ones are added up."""
    width = min(map(len, sketches))
    return np.array([np.frombuffer(s, np.uint8).reshape(width, -1).sum(axis=1, dtype=np.int32) for s in sketches])


def reachable(sizes: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """Label of each set's piece of the graph of pairs that their sketches don't rule out; -1 for a piece of one."""
    n, wide = len(sizes), sketches.astype(np.int32)
    label = np.arange(n)
    for i in range(n - 1):
        bound = (sizes[i] + sizes[i + 1 :]) * (100 - percent) // (100 + percent)
        near = np.flatnonzero(np.abs(wide[i + 1 :] - wide[i]).sum(axis=1) <= bound) + i + 1
        for old in np.unique(label[near]):
            if old != label[i]:
                label[label == old] = label[i]
    alone = np.bincount(label, minlength=n) == 1
    return np.where(alone[label], -1, label)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows that come sorted by ``keys``, one at a time."""
    key, rows = None, []
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in batch.schema.names if c not in keys]
        for own, row in zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*values)):
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            rows.append(row)
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of whole numbers as batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], names=names)


def _near_by_sketch(percent: int):
    """Pairs of ids that join the members of a group which their sketches allow to link: a star for each piece."""

    def rows(batches):
        for _, members in _groups(batches, ["name", "p", "q"]):
            members = sorted(set(members))
            if len(members) > 1:
                ids, sizes, sketches = zip(*members)
                pieces = reachable(np.array(sizes), alike(sketches), percent)
                first: dict[int, int] = {}
                for piece, i in zip(pieces.tolist(), ids):
                    if piece >= 0 and first.setdefault(piece, i) != i:
                        yield first[piece], i

    return lambda batches: _batches(rows(batches), ["u", "v"])


def _verified_links(percent: int):
    """Verified links of each group as a forest under smallest ids."""

    def rows(batches):
        for _, members in _groups(batches, ["name", "p", "q"]):
            members = sorted(set(members))
            if len(members) > 1:
                names = [i for i, _ in members]
                for root, other in spanning_links([np.frombuffer(e, np.uint64) for _, e in members], percent):
                    yield names[root], names[other]

    return lambda batches: _batches(rows(batches), ["u", "v"])


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members (name, id, size) of named groups, cut into blocks: a row for each pair (p, q) of blocks that a member is in."""
    blocks = members.groupBy("name").agg(F.count("*").alias("n"), F.sum("size").alias("e")).select(
        "name", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("e") / BLOCK_ELEMENTS)).cast("int").alias("nb"))
    return (
        members.join(blocks, "name")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("p", F.least("own", "with").cast("bigint")).withColumn("q", F.greatest("own", "with").cast("bigint"))
        .drop("nb", "own", "with")
    )


def _by_group(rows: DataFrame, *columns: str) -> DataFrame:
    group = ["name", "p", "q"]
    return rows.select(*group, *columns).repartition(*group).sortWithinPartitions(*group)


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Smallest reachable node of every node of the edges (u, v): rows (node, component).

    Alternating large-star and small-star contractions; minima are aggregated with partial sums, so a node with
    very many neighbours is no group in memory. Every round is written to the shared folder, the first by at most ``tasks``
    tasks; a round has no more edges than the one before it.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", tasks)
    state = _fingerprint(edges)
    tasks = tasks_for(edges.sparkSession, state[0])
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node go to the smallest of its neighbours and itself.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its neighbours below go to the smallest of them.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, stage(small.union(below.select("u", F.col("m").alias("v"))).distinct(), "edges", tasks)
        release(before)
        now = _fingerprint(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text): see the module's text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    own = stage(texts.mapInArrow(_digests(shingle), "doc_id long, size long, a long, b long, sketch binary"), "sets")
    tasks = tasks_for(spark, own.count())
    classes = stage(
        own.where("size > 0").groupBy("a", "b", "size").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")),
        "classes", max(tasks, own.rdd.getNumPartitions()),
    )

    rows = texts.mapInArrow(_signature_rows(shingle, percent), "signature long, class long")
    pairs = stage(
        rows.repartition("signature").sortWithinPartitions("signature", "class").mapInArrow(_families, "leader long, class long").distinct(),
        "families", tasks,
    )
    members = pairs.union(pairs.select("leader", F.col("leader").alias("class")).distinct())

    # A class is known by its digest's first half; should two sets share it, both are members.
    held = classes.where("id is not null").withColumnRenamed("a", "class").select("class", "id", "size", "sketch")
    families = members.join(held, "class").withColumnRenamed("leader", "name")
    near = components(
        _by_group(_in_blocks(families), "id", "size", "sketch").mapInArrow(_near_by_sketch(percent), "u long, v long"), tasks
    )
    release(pairs)
    pieces = stage(
        near.select(F.col("component").alias("name"), F.col("node").alias("id"))
        .union(near.select(F.col("component").alias("name"), F.col("component").alias("id")).distinct())
        .join(held.select("id", "class", "size"), "id"),
        "pieces", tasks,
    )
    wanted = spark.sparkContext.broadcast(bitmap_of(pieces, "id", BITMAP_BITS))
    contents = (
        texts.mapInArrow(_elements(shingle, wanted), "class long, id long, elements binary")
        .join(pieces.select("class", "id"), ["class", "id"], "left_semi")
        .groupBy("class", "id").agg(F.first("elements").alias("elements"))
    )
    links = _by_group(_in_blocks(pieces).join(contents, ["class", "id"]), "id", "elements").mapInArrow(_verified_links(percent), "u long, v long")
    found = components(links, tasks)
    release(pieces)
    named = classes.join(found, classes["id"] == found["node"], "left").select(
        "a", "b", F.coalesce("component", "id").alias("component_id")
    )
    return own.join(named, ["a", "b"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
