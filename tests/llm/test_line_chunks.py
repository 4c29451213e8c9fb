"""Chunked line dedup against a plain version."""

import random

from dayspan.llm.line_chunks import line_chunks, remove_repeated_chunks
from dayspan.llm.common import text_slices
import numpy as np
import pyarrow as pa


def chunks(text):
    """[(start, next start, bytes)] of the chunks that count."""
    batch = pa.record_batch({"text": pa.array([text])})
    out = []
    for _, _, data, offsets in text_slices(batch):
        for _, a, b, c, _ in zip(*line_chunks(data, offsets, 3)):
            out.append((int(a), int(c), data[a:b].tobytes()))
    return out


def plain(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, cut = {}, {}
    for i, text in rows:
        for a, c, data in chunks(text or ""):
            if first.setdefault(data, (i, text, a)) != (i, text, a):
                cut.setdefault((i, text), []).append((a, c))
    out = []
    for i, text in rows:
        data, at, kept = (text or "").encode(), 0, []
        for a, c in sorted(cut.get((i, text), [])):
            kept.append(data[at:a])
            at = c
        kept.append(data[at:])
        out.append((i, b"".join(kept).decode().rstrip("\n") if (i, text) in cut else text, len(cut.get((i, text), []))))
    return out


def corpus(seed=2, n=150):
    r = random.Random(seed)
    lines = [" ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(1, 12))) for _ in range(3000)]
    passage = "\n".join(r.sample(lines, 12))
    paragraph = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(n):
        own = r.sample(lines, r.randrange(0, 15))
        if r.random() < 0.3:
            own.insert(r.randrange(len(own) + 1), passage)
        if r.random() < 0.3:
            own.insert(r.randrange(len(own) + 1), paragraph)
        rows.append((i, r.choice(["", "\n", " \n"]) + "\n".join(own) + r.choice(["", "\n\n"])))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (500, None), (501, ""), (502, "\n\n \n"), (503, "é" * 50000), (503, "é" * 50000)], passage, paragraph


def test_matches_plain_version(spark):
    rows, passage, paragraph = corpus()
    df = spark.createDataFrame([(*x, "k", 5) for x in rows], "doc_id long, text string, hash string, at int").repartition(7)
    got = remove_repeated_chunks(df)
    assert got.columns == ["doc_id", "text", "hash", "at", "n_chunks_removed"]
    got = got.collect()
    assert len(got) == len(rows)
    assert sorted({(r["doc_id"], r["text"], r["n_chunks_removed"]) for r in got}, key=str) == sorted(plain(rows), key=str)
    texts = [r["text"] or "" for r in got]
    # A single line, however long, is no chunk of several lines.
    assert sum(paragraph in t for t in texts) >= sum(paragraph in (t or "") for _, t in rows) / 2
    held = sum(sum(line in t.split("\n") for line in passage.split("\n")) for t in texts)
    before = sum(sum(line in (t or "").split("\n") for line in passage.split("\n")) for _, t in rows)
    assert held < before / 3


def test_boundaries_resist_shifts():
    rows, _, _ = corpus(9, 40)
    for _, text in rows[:40]:
        if text.count("\n") > 8:
            a = {c[2] for c in chunks(text)}
            b = {c[2] for c in chunks("one more line\n" + text)}
            assert len(a - b) <= 2


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert remove_repeated_chunks(spark.createDataFrame([], schema)).collect() == []
    text = "\n".join(" ".join(f"q{i}{j}" for i in range(9)) for j in range(2))
    assert len(chunks(text)) == 1
    got = remove_repeated_chunks(spark.createDataFrame([(None, text), (1, text), (2, text), (3, "one long line " * 50), (4, "one long line " * 50)], schema)).collect()
    assert sorted((str(r["doc_id"]), r["text"] == text, r["n_chunks_removed"]) for r in got) == [("1", False, 1), ("2", False, 1), ("3", False, 0), ("4", False, 0), ("None", True, 0)]
