"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayspan.llm.resampling import Payloads, resample, run_crcs, shifts

DOCS, TARGET = "doc_id bigint, text string", "item_id bigint, text string"
LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features(text, runs=(1, 1)):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(runs[0], runs[1] + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, runs=(1, 1), buckets=10_000, percent=10, least=20, seed=2024):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, runs):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(x for _, x in target)
    gains = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        found = [gains[zlib.crc32(f.encode()) % buckets] for f in features(text, runs)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words(text)), len(found), weight, score, None])
    eligible = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, r in enumerate(eligible[: percent * len(eligible) // 100], start=1):
        r[5] = rank
    return sorted(map(tuple, rows), key=str)


def corpus(seed=1, n=400):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" if i % 3 else f"Wört{i}€" for i in range(500)]
    docs = []
    for i in range(n):
        k = int(rng.integers(0, 80))
        text = "".join(vocabulary[int(j)] + [" ", ", ", "\n", "-", "\x00"][int(rng.integers(5))] for j in rng.zipf(1.3, k) % 500)
        docs.append((i, None if i % 40 == 7 else text + f" id{i}"))
    target = [(i, " ".join(vocabulary[int(j)] for j in rng.integers(0, 60, 30))) for i in range(20)] + [(99, None), (100, "")]
    return docs, target


def run(spark, docs, target, **more):
    out = resample(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(target, TARGET), **more)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, out.collect()), key=str)


def test_shifts_append_zero_bytes():
    """crc(a + b) = shift(crc(a), len(b)) ^ crc(b), for any lengths."""
    from dayspan.llm.resampling import _apply

    lengths = np.array([0, 1, 2, 7, 64, 1000, 123_457])
    operators = shifts(lengths)
    for i, n in enumerate(lengths):
        a, b = b"some text", bytes(range(256)) * 500
        crc = _apply(operators, np.array([i]), np.array([zlib.crc32(a)], np.uint32))[0] ^ np.uint32(zlib.crc32(b[:n]))
        assert crc == zlib.crc32(a + b[:n])


@pytest.mark.parametrize("most_words", [0, 3, 50_000])
def test_payloads_and_runs_do_not_depend_on_the_dictionary(most_words):
    payloads = Payloads(most_words)
    rng = np.random.default_rng(7)
    for _ in range(12):
        tokens = [f"t{int(j)}".encode() for j in rng.zipf(1.2, 2000) % 3000] + ["élève".encode(), b"x" * 200]
        text = b"  " + b"  ".join(tokens) + b" "
        starts = np.array([m.start() for m in re.finditer(rb"[^ ]+", text)])
        ends = np.array([m.end() for m in re.finditer(rb"[^ ]+", text)])
        found = payloads.of(text, starts, ends)
        assert [int(p) for p in found] == [len(t) << 32 | zlib.crc32(t) for t in tokens]
        for k, crcs in enumerate(run_crcs(found, 3), start=1):
            assert [int(c) for c in crcs[:50]] == [zlib.crc32(b" ".join(tokens[i : i + k])) for i in range(50)]
            assert len(crcs) == len(tokens) - k + 1
    assert len(payloads.automaton) <= most_words and (most_words < 1000 or len(payloads.automaton) > 256)


@pytest.mark.parametrize("runs,buckets", [((1, 1), 10_000), ((1, 2), 100_000), ((2, 4), 37)])
def test_matches_brute_force(spark, runs, buckets):
    docs, target = corpus()
    assert run(spark, docs, target, runs=runs, buckets=buckets) == brute(docs, target, runs, buckets)


def test_repeated_and_null_ids_and_ties(spark):
    docs, target = corpus(2, 120)
    docs = docs + docs[:30] + [(None, t) for _, t in docs[:40]] + [(3, t) for _, t in docs[40:60]]
    assert run(spark, docs, target, percent=50) == brute(docs, target, percent=50)


def test_no_target_empty_tables_and_a_very_long_text(spark):
    docs, _ = corpus(3, 50)
    docs.append((1000, "lorem IPSUM dolor " * 300_000))
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, None), (2, "")], [(1, "a")]) == brute([(1, None), (2, "")], [(1, "a")])
    assert run(spark, docs, [(1, "a")], percent=0) == brute(docs, [(1, "a")], percent=0)
    assert run(spark, docs, [(1, "a")], percent=100) == brute(docs, [(1, "a")], percent=100)


def test_clashing_columns(spark):
    docs, target = corpus(4, 60)
    extra = {c: F.lit("x") for c in ("found", "score", "rank", "n_words", "weight", "block", "place", "a`b")}
    out = resample(spark.createDataFrame(docs, DOCS).withColumns(extra), spark.createDataFrame(target, TARGET).withColumns(extra))
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, target)
