"""Line frequency rules, sharding and licence scans on small tables."""

import random
import re
import zlib
from collections import Counter

from dayspan.llm.licences import KNOWN, scan_licences
from dayspan.llm.line_frequency import judge_by_lines, without_frequent_lines
from dayspan.llm.sharding import histogram_shards
from pyspark.sql import functions as F


def plain_rules(rows, max_docs, share):
    norm = lambda x: re.sub(r"[ \t-\r]+", " ", x).strip(" ").lower()
    counts = Counter()
    for _, text, host in rows:
        counts.update({(host, norm(x)) for x in (text or "").split("\n") if norm(x)})
    out = []
    for i, text, host in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        hit = {k for j in range(len(words) - 2) if grams[tuple(words[j : j + 3])] > 1 for k in range(j, j + 3)}
        lines = [x for x in text.split("\n") if norm(x)]
        gone = [x for x in lines if counts[host, norm(x)] > max_docs]
        left = len(words) - sum(len(norm(x).split(" ")) for x in gone)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed,
                    not failed and left > 0 and 100 * left >= share * len(words), len(gone), left))
    return sorted(out, key=str)


def test_line_rules_match_a_plain_version(spark):
    r = random.Random(4)
    lines = [" ".join(r.choice(["a", "Bb", "c#", "É|", "dd", "e", "ff", "g"]) for _ in range(r.randrange(0, 12))) for _ in range(200)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 25))), r.choice(["h1", "h1", "h2", None])) for i in range(80)]
    rows += [(100, None, "h1"), (101, "", "h1"), (102, " \n\t", None), (None, lines[0] * 9, "h2"), (103, "w " * 30000, "h1"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, h int, words int")
    assert sorted((tuple(x) for x in judge_by_lines(docs, max_docs=12).collect()), key=str) == plain_rules(rows, 12, 50)
    cut = without_frequent_lines(docs, max_docs=12)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert judge_by_lines(docs.limit(0)).collect() == []


def check_shards(got, rows, shards, tolerance, together=False):
    assert sorted((x["doc_id"] or -1, x["size"], x["text_crc32"]) for x in got) == sorted(
        (i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots = Counter(), {}
    for x in got:
        assert x["law"] == "bytes" and x["grown_shard"] is None and 0 <= x["shard"] < shards
        sizes[x["shard"]] += x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / shards, max(x["size"] for x in got)
    # Copies stay together: a boundary may be off by half of a group on either side of a shard.
    copies = Counter()
    for x in got:
        copies[x["text_crc32"]] += x["size"]
    largest = max([largest, *(n for n in copies.values() if n <= mean)]) if together else largest
    assert all(abs(sizes[s] - mean) <= 2 * tolerance * mean + largest for s in range(shards))


def test_shards_are_even_with_a_hot_key(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, "copy " * 20 if r.random() < 0.4 else "x" * r.randrange(300)) for i in range(3000)] + [(None, None), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(*x, 1, "n") for x in rows], "doc_id long, text string, part int, number string").repartition(6)
    check_shards(histogram_shards(docs, 10).collect(), rows, 10, 0.002, together=True)
    monkeypatch.setattr("dayspan.llm.sharding.PART_ROWS", 100)
    check_shards(histogram_shards(docs, 10, key=F.col("doc_id")).collect(), rows, 10, 0.002)
    check_shards(histogram_shards(docs, 7, key=F.lit(5)).collect(), rows, 7, 0.002)


def test_few_rows_and_none(spark):
    schema = "doc_id long, text string"
    assert histogram_shards(spark.createDataFrame([], schema)).collect() == []
    got = histogram_shards(spark.createDataFrame([(1, "a"), (2, "b" * 100000)], schema), 40).collect()
    assert sorted(x["doc_id"] for x in got) == [1, 2] and all(x["slot"] == 0 or len(got) == 2 for x in got)


def test_licences(spark):
    mit = dict(KNOWN)["MIT"]
    texts = [mit, "MIT licence below\n" + mit, "Copyright (c) 2020 Someone\n(c) others\n\n" + mit.upper().replace(",", " ;") + "\nAll rights reserved.",
             mit.replace("sublicense", "sublicence"), None, "", "!!", "prose\n  licensed under the apache licence, version 2.0\nmore", "x" * 100000,
             "Released under the MIT License.", "Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "d", "l") for i, t in enumerate(texts)], "doc_id long, text string, d string, licence_id string")
    got = {x["doc_id"]: x for x in scan_licences(docs).collect()}
    assert {i: x["licence_id"] for i, x in got.items() if x["licence_id"]} == {0: "MIT", 2: "MIT", 3: "MIT", 9: "MIT-notice", 10: "MIT-notice"}
    assert {i: x["notices"] for i, x in got.items() if x["notices"]} == {7: "Apache-2.0-notice", 9: "MIT-notice", 10: "MIT-notice"}
    assert [i for i, x in sorted(got.items()) if x["canonical_sha256"] is None] == [4, 5, 6]
    assert scan_licences(docs.limit(0)).collect() == []


def test_equal_texts_share_a_shard(spark):
    """Groups of copies lie in one shard unless they alone exceed a shard's share."""
    r = random.Random(8)
    texts = [f"group {i} " * r.randrange(1, 30) for i in range(150)]
    rows = [(n, r.choice(texts[: 40 if n % 2 else 150])) for n in range(3000)] + [(5000 + n, "hot text " * 20) for n in range(1500)]
    out = histogram_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=10).collect()
    by_id = dict(rows)
    total, parts, sizes = sum(x["size"] for x in out), {}, {}
    for x in out:
        parts.setdefault(by_id[x["doc_id"]], set()).add(x["shard"])
        sizes[by_id[x["doc_id"]]] = sizes.get(by_id[x["doc_id"]], 0) + x["size"]
    assert {t for t, p in parts.items() if len(p) > 1} == {t for t, s in sizes.items() if s > total / 10}
    assert len(parts["hot text " * 20]) > 2
    for shard in range(10):
        assert abs(sum(x["size"] for x in out if x["shard"] == shard) - total / 10) <= total / 10
        assert sorted(x["slot"] for x in out if x["shard"] == shard) == list(range(sum(x["shard"] == shard for x in out)))


def test_licence_texts_in_any_wrapping_and_dress(spark):
    """Title, copyright lines, wrapping and neighbouring spellings make no difference; another text does."""
    import textwrap

    from dayspan.llm.licences import canonical

    texts, want = [], []
    for name, text in KNOWN:
        if len(text) > 300:
            for width in range(40, 121, 1 if name == "MIT" else 16):
                texts.append("\n".join(textwrap.fill(p, width) for p in text.split("\n")))
                want.append(name)
    mit, bsd = dict(KNOWN)["MIT"], dict(KNOWN)["BSD-3-Clause"]
    dressed = [("MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit, "MIT"), ("The MIT License (MIT)\n\nCopyright © 1999-2020, A B. All rights reserved.\n" + mit, "MIT"),
               ("BSD 3-Clause License\n\nCopyright (c) 2001, X\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"), ("Copyright 2020 by Y\n" + mit.replace(" ", "  "), "MIT"),
               (mit + " extra", None), (mit.replace("without restriction", "with restriction"), None)]
    texts, want = texts + [t for t, _ in dressed], want + [w for _, w in dressed]
    rows = scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["licence_id"] for r in rows}
    assert [got[i] for i in range(len(texts))] == want
    both = spark.createDataFrame([("licence licence licence", "license license license"), ("the copyright holders\ncopyright notice", "the copyright holders copyright notice")], "a string, b string")
    assert both.select(canonical(F.col("a")) == canonical(F.col("b"))).distinct().collect() == [(True,)]


def test_the_callers_table_decides_which_lines_count(spark):
    known = spark.createDataFrame([("b", "Free for all purposes"), ("a", "FREE, for all purposes!"), ("c", None), ("d", "©")], "licence_id string, text string")
    docs = spark.createDataFrame([(1, "x\nfree for all\tpurposes.\ny"), (2, "free for all purposes"), (3, "Licensed under the MIT License.")], "doc_id long, text string")
    rows = {r["doc_id"]: (r["licence_id"], r["notices"]) for r in scan_licences(docs, known).collect()}
    assert rows == {1: (None, "a"), 2: ("a", "a"), 3: (None, "")}
