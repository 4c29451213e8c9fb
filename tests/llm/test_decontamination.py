"""Winnowed decontamination against plain window lookups."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from dayspan.llm.decontamination import contamination, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items):
    windows = {}
    for item_id, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in windows[tuple(w[i : i + n])] if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 8))
def test_winnow_keeps_a_minimum_of_every_run(values, run):
    flags = winnow(np.array(values, np.uint64), run)
    for i in range(len(values) - run + 1):
        assert any(flags[j] and values[j] == min(values[i : i + run]) for j in range(i, i + run))


def test_matches_plain_lookup(spark):
    r = random.Random(5)
    vocabulary = ["Alpha", "beta", "été", "x1", "Ünder", "42", "the", "of", "ß", "go"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 40)))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "--"), (93, "single"), (93, "two words"), (None, "no id but some words here that are ten at least")]
    docs = []
    for i in range(200):
        text = [r.choice(vocabulary) for _ in range(r.randrange(0, 50))]
        if r.random() < 0.5:
            words = r.choice(items)[1] or ""
            words = words.split()[r.randrange(3) :]
            at = r.randrange(len(text) + 1)
            text[at:at] = words
        docs.append((i, r.choice([" ", ", ", "\n"]).join(text)))
    docs += [(1000, None), (1001, ""), (1002, "!!"), (1003, "SINGLE"), (7, "no id but some words here that are ten at least"), (None, "two-words")]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, uid int, hits string")
    b = spark.createDataFrame([(*x, 3) for x in items], "item_id int, text string, size int")
    got = sorted((tuple(x) for x in contamination(d, b).collect()), key=str)
    assert got == plain(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, items).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in contamination(one, items).collect()] == [(1, 3, 0, 0)]
