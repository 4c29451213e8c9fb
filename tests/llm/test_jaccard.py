"""PartEnum join against all pairs."""

import random
import re

import numpy as np
import pytest

from dayspan.llm.common import mix
from dayspan.llm.partenum import Sets, alike, components, jaccard_components, reachable, signatures, spanning_links


def brute(rows, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    label = [i for i, _ in rows]
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted((rows[i][0], len(sets[i]), label[i]) for i in range(len(rows)))


def near_copies(seed, n, words=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    base = [[r.choice(vocabulary) for _ in range(r.randrange(1, words))] for _ in range(n // 8 + 1)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    for _ in range(n):
        text = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        if r.random() < 0.3:
            text = text[: r.randrange(1, len(text) + 1)] + [passage]
        out.append(" ".join(text))
    return out


def test_matches_all_pairs(spark):
    texts = near_copies(1, 300) + ["", None, " \t\n", "one", "One ONE", "ONE one", "É", "é"] + ["same text of five words here"] * 5
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.selectExpr("doc_id", "text", "'x' as size", "1 as class", "2 as n_shingles")  # clashing names
    got = sorted(tuple(r) for r in jaccard_components(df).collect())
    assert got == brute(rows)


def test_large_family_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(r.randrange(0, 3)):
            text[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr("dayspan.llm.partenum.BLOCK_DOCS", 16)
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (4, text), (4, text), (None, "alone on its own here now"), (9, text + " more")]
    got = sorted(map(str, (tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(["(None, 36, 4)", "(4, 36, 4)", "(4, 36, 4)", "(None, 2, None)", "(9, 37, 4)"])


class Given:
    """Sets by their elements instead of by texts."""

    def __new__(cls, *sets):
        out = object.__new__(Sets)
        out.elements = np.concatenate(sets)
        out.sizes = np.array([len(s) for s in sets])
        out.bounds = np.concatenate([[0], np.cumsum(out.sizes)])
        out.totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(out.elements), dtype=np.uint64)])
        return out


@pytest.mark.parametrize("size", [5, 9, 17, 60, 300, 2000])
def test_linked_sets_share_a_signature(size):
    r = np.random.default_rng(size)
    for _ in range(100):
        a = np.unique(r.integers(0, 1 << 64, size, dtype=np.uint64))
        drop = r.integers(0, size // 5 + 1)
        add = r.integers(0, size // 5 + 1)
        b = np.unique(np.concatenate([a[drop:] if r.random() < 0.5 else np.delete(a, r.choice(size, drop, False)), r.integers(0, 1 << 64, add, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common) and not np.array_equal(a, b):
            rows, found = signatures(Given(a, b), 80)
            assert len(np.intersect1d(found[rows == 0], found[rows == 1]))


def test_sketches_rule_out_no_link():
    r = np.random.default_rng(7)
    for _ in range(200):
        size = int(r.integers(5, 3000))
        a = np.unique(r.integers(0, 1 << 64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([np.delete(a, r.choice(size, size // 12, False)), r.integers(0, 1 << 64, size // 12, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            given = Given(a, b)
            assert reachable(given.sizes, alike(given.sketches()), 80).tolist() == [0, 0]


def test_spanning_links():
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    assert spanning_links(sets, 80) == [(0, 1)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_subsets_of_parts_share_a_signature_with_every_linked_set():
    """Small sets take every two of three parts; whatever may differ within the bound, a signature is shared."""
    import dayspan.llm.partenum as partenum

    assert partenum.SUBSETS == (3, 2)
    r = np.random.default_rng(11)
    for size in (5, 6, 9, 14, 30, 60, 90):
        for _ in range(40):
            base = r.integers(0, 1 << 63, size, dtype=np.uint64)
            k = size * 20 // 180 * 2
            gone = int(r.integers(0, k // 2 + 1))
            other = np.concatenate([base[gone:], r.integers(0, 1 << 63, k // 2 - gone if r.random() < 0.5 else gone, dtype=np.uint64)])
            both, union = len(np.intersect1d(base, other)), len(np.union1d(base, other))
            if 100 * both < 80 * union:
                continue
            sets = Sets.__new__(Sets)
            parts = [np.sort(base), np.sort(other)]
            sets.elements, sets.bounds = np.concatenate(parts), np.cumsum([0, len(base), len(other)])
            sets.sizes = np.diff(sets.bounds)
            sets.totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.elements), dtype=np.uint64)])
            rows, found = signatures(sets, 80)
            assert both == union or set(found[rows == 0].tolist()) & set(found[rows == 1].tolist())


def test_a_choice_covers_two_parts():
    """The signatures of a partition with three filled parts: one for each pair, each changed by its own parts only."""
    from dayspan.llm.partenum import _cut

    r = np.random.default_rng(3)
    def of(elements):
        sets = Sets.__new__(Sets)
        sets.elements = np.sort(elements)
        sets.bounds, sets.sizes = np.array([0, len(elements)]), np.array([len(elements)])
        sets.totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.elements), dtype=np.uint64)])
        return _cut(sets, np.array([0]), 1, 3, 2)

    thirds = [r.integers(i << 62, (i + 1) << 62, 4, dtype=np.uint64) // np.uint64(3) + np.uint64(0) for i in range(3)]
    low, width = [0, (1 << 64) // 3 + 1, 2 * ((1 << 64) // 3) + 2], (1 << 64) // 3 - 2**34
    thirds = [np.array([low[i] + int(x) % width for x in r.integers(0, 1 << 63, 4)], np.uint64) + np.uint64(2**33) for i in range(3)]
    _, whole, cost = of(np.concatenate(thirds))
    assert len(whole) == 3 and cost.tolist() == [2]
    for i in range(3):
        changed = [t if j != i else t + np.uint64(5) for j, t in enumerate(thirds)]
        _, other, _ = of(np.concatenate(changed))
        assert len(set(whole.tolist()) & set(other.tolist())) == 1
        _, fewer, cost = of(np.concatenate([t for j, t in enumerate(thirds) if j != i]))
        assert len(fewer) == 3 and cost.tolist() == [2]
    _, single, cost = of(thirds[0])
    assert len(single) == 2 and cost.tolist() == [1]


def test_small_rounds_are_few_files(spark):
    """A round of a few edges is written by few tasks, however many partitions its shuffle has."""
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long"))
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(1, 201)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
