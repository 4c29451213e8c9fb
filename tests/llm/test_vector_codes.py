"""Integer product quantisation against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayspan.llm.vector_codes import compress_vectors, fits, hadamard, nearest, transform

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_nearest(parts, entries):
    distances = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, e)) for e in entries] for p in parts]
    return [d.index(min(d)) for d in distances], [min(d) for d in distances]


def brute(rows, parts=16, entries=64, rounds=2):
    """The same in plain Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) and abs(x) <= 1e25 for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, list(map(float, r[1]))))
    vectors = [[int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[tuple(v[p * width : (p + 1) * width]) for v in vectors] for p in range(parts)]
    books = [c[:entries] for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            which, _ = brute_nearest(cut[p], books[p])
            for e in range(len(books[p])):
                own = [c for c, w in zip(cut[p], which) if w == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    codes, errors = ["" for _ in kept], [0] * len(kept)
    for p in range(parts):
        which, far = brute_nearest(cut[p], books[p])
        codes = [c + f"{w:02x}" for c, w in zip(codes, which)]
        errors = [a + b for a, b in zip(errors, far)]
    label = {}
    for (_, _, lab), e in zip(kept, errors):
        label[lab] = label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e if e < 1 << 63 else None, label[lab] if label[lab] < 1 << 63 else None, digest)
                   for (i, _, lab), c, e in zip(kept, codes, errors)), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = compress_vectors(df, "vec_id", "embedding", "label", **more)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("size", [1, 2, 4, 8, 32])
def test_transform_is_orthogonal_and_in_sequency_order(size):
    h = hadamard(size)
    assert (h @ h.T == size * np.eye(size)).all()
    assert [(np.diff(row) != 0).sum() for row in h] == list(range(size))


@pytest.mark.parametrize("width,largest", [(1, 3), (3, 2), (4, 300), (5, 10**6), (16, 50)])
def test_nearest_matches_brute_force_with_ties(width, largest):
    rng = np.random.default_rng(width)
    parts = rng.integers(-largest, largest + 1, (500, width))
    entries = np.concatenate([rng.integers(-largest, largest + 1, (40, width)), parts[:9], parts[:9]])
    got = nearest(parts, entries)
    want = brute_nearest(parts.tolist(), entries.tolist())
    assert got[0].tolist() == want[0] and got[1].tolist() == want[1]
    big = nearest(parts.astype(object) * 10**20, entries.astype(object) * 10**20)
    assert big[0].tolist() == want[0] and big[1].tolist() == [d * 10**40 for d in want[1]]


def test_bound_of_machine_integers():
    worst = np.array([[2**27 - 1] * 4]), np.array([[-(2**27)] * 4])
    assert not fits(2**28, 4) and fits(2**26, 4)
    a, b = transform(worst[0] // 2), transform(worst[1] // 2)
    assert sum((int(x) - int(y)) ** 2 for x, y in zip(a[0], b[0])) < 1 << 63


def vectors(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (9, dim))
    return [(int(i), [float(x) for x in np.float32(centres[i % 9] + rng.normal(0, 0.05, dim))], None if i % 11 == 0 else int(i % 4))
            for i in rng.permutation(n)]


def test_matches_brute_force(spark):
    rows = vectors(3, 300)
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [None] + [0.0] * 63, 1), (902, [nan] * 64, 1), (-5, [inf] + [0.0] * 63, 1), (903, [-inf] * 64, None)]
    rows += [rows[0], rows[0], (None, rows[1][1], 2), (7, rows[2][1], 3)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("dim,parts,entries,rounds", [(10, 16, 64, 2), (33, 4, 8, 1), (12, 3, 256, 3), (5, 1, 1, 0)])
def test_other_shapes(spark, dim, parts, entries, rounds):
    rows = vectors(dim, 120, dim)
    assert run(spark, rows, parts=parts, entries=entries, rounds=rounds) == brute(rows, parts, entries, rounds)


def test_uneven_lengths_few_rows_ties_and_huge_components(spark):
    rows = [(1, [0.5, -0.5], 1), (2, [], 1), (3, [1.0] * 40, None), (4, [1.0] * 40, None), (5, [1e18, 3.0], 2), (6, [-2e9, 1e30], 2)]
    assert run(spark, rows) == brute(rows)
    same = [(i, [0.25] * 16, 0) for i in range(100)]
    assert {r[1] for r in run(spark, same)} == {"00" * 16}
    assert run(spark, [(1, [], 1), (2, [], None)]) == brute([(1, [], 1), (2, [], None)])


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []
    rows = vectors(4, 40)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "code", "error", "vector", "at", "n", "a`b")})
    got = compress_vectors(df, "vec_id", "embedding", "label").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
