"""The mix against brute force: targets, schedule, pieces, edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayspan.llm.mixing import _rank, _slot, mix_schedule, mix_sources, prepare, source_targets

SCHEMA = "doc_id bigint, text string, source string"


def water_fill(sizes, weights=3, most=3):
    """Share by weight, cut at the cap, share the rest again, until nobody is above."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: i % weights + 1 for i, n in enumerate(names)}
    target, free, rest = {}, list(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] >= most * sizes[n]]
        if not over:
            target |= {n: level * weight[n] for n in free}
            break
        for n in over:
            target[n] = float(most * sizes[n])
            rest -= target[n]
            free.remove(n)
    return target


def corpus(seed=1, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = ["a", "b", "c", "Ä", None, "big"][int(rng.choice(6, p=[0.05, 0.05, 0.1, 0.1, 0.2, 0.5]))]
        words = 0 if rng.random() < 0.1 else int(rng.integers(1, 400)) if i % 50 else 9000
        rows.append((i, " \t".join("w" for _ in range(words)) if i % 9 else None, source))
    return rows


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 1, None: 50}, {"x": 0, "y": 10}, {"x": 7}, {"x": 0},
    {f"s{i:02}": (i * 37) % 11 * 100 for i in range(25)},
])
def test_targets_are_the_fixed_point_of_sharing(spark, sizes):
    df = spark.createDataFrame([(n, s) for n, s in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys()
    for n in want:
        assert got[n] == pytest.approx(want[n], rel=1e-12, abs=1e-9)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_slots_and_ranks_match_counting(spark, bits):
    size = 1 << bits
    reverse = [int(format(n, f"0{bits}b")[::-1], 2) for n in range(size)]
    bounds = [(a, b) for a in range(size) for b in range(a + 1, size + 1, max(1, size // 7))]
    cells = [(a, b, c) for a, b in bounds for c in range(a, b)]
    df = spark.createDataFrame(cells, "first bigint, end bigint, cell bigint").select(
        "first", "end", "cell", _slot("cell", bits).alias("slot"), _rank("cell", "first", "end", bits).alias("rank"))
    for r in df.collect():
        assert r["slot"] == reverse[r["cell"]]
        assert r["rank"] == sum(r["first"] <= reverse[m] < r["end"] for m in range(r["slot"]))


def test_schedule(spark):
    rows = corpus()
    docs, grid, bits = prepare(spark.createDataFrame(rows, SCHEMA), block=64)
    bounds = {r["number"]: r for r in grid.collect()}
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    pieces = [r.asDict() for r in mix_schedule(docs, grid, bits).collect()]
    block = next(iter(bounds.values()))["block"]
    assert 32 < block <= 64 and all(r["end"] <= 1 << bits for r in bounds.values())
    by_slot, by_copy = {}, {}
    for p in pieces:
        by_slot.setdefault(p["slot"], []).append(p)
        by_copy.setdefault((p["doc_id"], p["epoch"]), []).append(p)
    for slot, found in by_slot.items():
        (number,) = {p["number"] for p in found}
        reverse = int(format(slot, f"0{bits}b")[::-1], 2)
        assert bounds[number]["first"] <= reverse < bounds[number]["end"]
        # The words of a block follow one another without a gap.
        found.sort(key=lambda p: p["at"])
        assert all(a["at"] + a["length"] == b["at"] for a, b in zip(found, found[1:]))
        assert found[0]["at"] % block == 0 and sum(p["length"] for p in found) <= block
    for (doc, epoch), found in by_copy.items():
        found.sort(key=lambda p: p["start"])
        assert found[0]["start"] == 0 and all(a["start"] + a["length"] == b["start"] for a, b in zip(found, found[1:]))
        assert sum(p["length"] for p in found) <= sizes[doc] and epoch < 3
    for number, source in bounds.items():
        words = {s: sum(p["length"] for p in f) for s, f in by_slot.items() if f[0]["number"] == number}
        assert sum(words.values()) == source["goal"] == math.floor(source["target"])
        assert sum(w < block for w in words.values()) <= 1
        # Low discrepancy: any first part of the mix holds the source in about its share.
        share = (source["end"] - source["first"]) / (1 << bits)
        for upto in range(1, (1 << bits) + 1):
            assert abs(sum(s < upto for s in words) - share * upto) <= bits + 1


def test_epochs_are_shuffled_anew(spark):
    rows = [(i, "w " * 10, "small") for i in range(20)] + [(100 + i, "w " * 50, "large") for i in range(200)]
    docs, grid, bits = prepare(spark.createDataFrame(rows, SCHEMA), block=16)
    pieces = mix_schedule(docs, grid, bits).where("doc_id < 100").collect()
    orders = [[p["doc_id"] for p in sorted(pieces, key=lambda p: p["at"]) if p["epoch"] == e and p["start"] == 0] for e in range(3)]
    assert [sorted(o) for o in orders] == [list(range(20))] * 3 and len({tuple(o) for o in orders}) == 3


def test_query_rows(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("clash"), "taken": F.lit(1), "number": F.lit(2), "a`b": F.lit(3)})
    got = mix_sources(df, block=100)
    again = mix_sources(df.repartition(9), block=100)
    out = got.collect()
    assert sorted(map(str, out)) == sorted(map(str, again.collect()))
    assert sorted(r["doc_id"] for r in out) == list(range(300))
    by_id = {i: (len((t or "").split()), s) for i, t, s in rows}
    totals = {}
    for r in out:
        assert (r["size"], r["source"]) == by_id[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        totals[r["source"]] = totals.get(r["source"], 0) + r["taken"]
    sizes = {}
    for n, s in by_id.values():
        sizes[s] = sizes.get(s, 0) + n
    want = water_fill(sizes)
    for s, total in totals.items():
        assert total == math.floor(want[s] + 1e-9) and {r["source_size"] for r in out if r["source"] == s} == {sizes[s]}


def test_repeated_rows_null_ids_ties_and_long_texts(spark):
    rows = [(1, "a b c", "x")] * 7 + [(None, "a b", "x")] * 5 + [(None, None, None), (2, "", "x"), (2, " \n ", "x"), (3, "w " * 200_000, "y")]
    out = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out) == sorted((i or 0, len((t or "").split())) for i, t, _ in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    x = [r for r in out if r["source"] == "x"]
    assert sum(r["taken"] for r in x) == math.floor(x[0]["target"]) == 3 * 31
    assert all(r["taken"] == 3 * r["size"] for r in x)


def test_empty_and_wordless_tables(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    out = mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in out) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
