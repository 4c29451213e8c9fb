"""Each stage of the pipeline against a plain version on a small corpus, and the whole of it."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dayspan.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "rejected", "lang_pred", "_removed", "_cuts", "size", "component_id", "key", "id", "contaminated", "a`b", "n_words")
GERMAN, ENGLISH = "der die und nicht ein ist wir haus straße sehr".split(), "the and not with a house street very we is".split()


def sentence(r, words, n):
    return " ".join(r.choice(words) + r.choice(["", str(r.randrange(40))]) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    items = [(1, "What colour is the deep sea at noon on a cloudy day in May?"), (2, "short item"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


PASSAGE = "what colour is the deep sea at noon on a cloudy day"


def corpus():
    r = random.Random(4)
    rows = [(i, sentence(r, ENGLISH if i % 3 else GERMAN, r.randrange(60, 120)), "en" if i % 3 else "de") for i in range(40)]
    block = "\n".join(sentence(r, ENGLISH, 12) for _ in range(20))
    rows += [(100 + i, sentence(r, ENGLISH, 30) + "\n" + block + "\n" + sentence(r, ENGLISH, 30), "en") for i in range(4)]
    near = rows[1][1]
    rows += [(200, near + " end", "en"), (7, near, "en"), (7, near, "en"), (None, near, "en")]
    rows += [(300, sentence(r, ENGLISH, 20) + " " + PASSAGE + " " + sentence(r, ENGLISH, 20), "en"), (301, "x short, ITEM y", "en")]
    rows += [(302, None, "en"), (303, "", None), (304, "12 -- 34", "en"), (None, sentence(r, GERMAN, 70), None), (None, PASSAGE, None)]
    rows += [(5, sentence(r, ENGLISH, 90), "en"), (5, sentence(r, ENGLISH, 90) + " " + PASSAGE, None)]
    return [(i, t, lang, f"s{n % 3}", len(t or "")) for n, (i, t, lang) in enumerate(rows)]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASHES}) if clash else df


def texts(df):
    return sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in df.collect())))


def as_text(rows):
    return sorted(map(str, rows))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_join(rows):
    """One row per group of linked documents, the one with the smallest id."""
    distinct = list(dict.fromkeys(rows))
    sets = [shingles(row[1]) for row in distinct]
    label = list(range(len(distinct)))
    links = [(i, j) for i in range(len(distinct)) for j in range(i)
             if distinct[i][:2] == distinct[j][:2] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in distinct:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for row, group in zip(distinct, label):
        groups.setdefault(group, []).append(row)
    return [min(g, key=lambda row: (row[0] is None, row[0] or 0)) for g in groups.values()]


def plain_decontamination(rows):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())

    item = words("What colour is the deep sea at noon on a cloudy day in May?")
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)} | {("short", "item")}
    return [row for row in rows if not any(
        tuple(words(row[1])[i : i + n]) in windows for n in (2, 10) for i in range(len(words(row[1])) - n + 1))]


def test_columns_stay(spark, sf_dir):
    docs = frame(spark, corpus())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [*COLUMNS, *CLASHES]
        assert {tuple(row)[len(COLUMNS):] for row in docs.collect()} == {tuple(CLASHES)}


def test_language_id_drops_what_it_rejects(spark, sf_dir):
    rows = corpus()
    left = texts(corpus_pipeline.identify_language(spark, frame(spark, rows), sf_dir))
    from dayspan.llm.language_id import Scorer, fit_dictionaries

    scorer = Scorer(fit_dictionaries(spark.createDataFrame(rows, SCHEMA)), 0.004)
    want = [row for row in rows if not scorer(row[1], bool(row[1] and re.search(r"[^\W\d_]", row[1])))[2]]
    assert left == as_text(want)
    assert not {302, 303, 304} & {row[0] for row in want} and len(want) > 45


def test_line_dedup_cuts_the_shared_block(spark, sf_dir):
    rows = corpus()
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, frame(spark, rows), sf_dir).where("doc_id >= 100 AND doc_id < 104").collect()}
    by_id = {row[0]: row[1] for row in rows}
    block = by_id[100].split("\n")[1:-1]
    assert sum(line in out[100] for line in block) == 20  # the first copy stays
    for i in (101, 102, 103):
        lines = by_id[i].split("\n")
        left = out[i].split("\n")
        assert left[0] == lines[0] and left[-1] == lines[-1] and len(left) < len(lines)
    others = [row for row in rows if not (row[0] is not None and 100 <= row[0] < 104)]
    assert texts(corpus_pipeline.dedup_lines(spark, frame(spark, others), sf_dir)) == as_text(others)


def test_join_keeps_one_of_each_group(spark, sf_dir):
    rows = corpus()
    assert texts(corpus_pipeline.join_near_copies(spark, frame(spark, [row[:2] + ("x", "y", 0) for row in rows]), sf_dir)) == as_text(
        plain_join([row[:2] + ("x", "y", 0) for row in rows]))


def test_a_unique_text_survives_its_ids_other_row(spark, sf_dir):
    """Ids repeat: the copy goes, the other text of that id stays; so with a null id."""
    r = random.Random(9)
    a, b, c = (sentence(r, ENGLISH, 50) for _ in range(3))
    rows = [(3, a, "", "", 0), (7, a, "", "", 0), (7, b, "", "", 0), (None, a, "", "", 0), (None, c, "", "", 0)]
    assert texts(corpus_pipeline.join_near_copies(spark, frame(spark, rows), sf_dir)) == as_text([rows[0], rows[2], rows[4]])


def test_decontamination_by_row(spark, sf_dir):
    rows = corpus()
    assert texts(corpus_pipeline.drop_benchmark_text(spark, frame(spark, rows), sf_dir)) == as_text(plain_decontamination(rows))
    rows = [(None, PASSAGE, "", "", 0), (None, "clean words", "", "", 0), (5, PASSAGE, "", "", 0), (5, "clean words", "", "", 0)]
    assert texts(corpus_pipeline.drop_benchmark_text(spark, frame(spark, rows), sf_dir)) == as_text([rows[1], rows[3]])


def test_packing_holds_every_document(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = corpus()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = corpus_pipeline.pack(spark, frame(spark, rows), sf_dir).collect()
    lengths = sorted(str((row[0], len(tokenizer.encode(row[1] or "", add_special_tokens=False).ids) + 1)) for row in rows)
    assert sorted(str((r["doc_id"], r["length"])) for r in out) == lengths
    spans = {}
    for r in out:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in spans.values():
        found.sort()
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and sum(n for _, n in found) <= 1024


def test_whole_pipeline(spark, sf_dir):
    rows = corpus()
    frame(spark, rows, clash=False).write.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r["doc_id"] for r in out if r["piece"] == 0]
    assert not {200, 300, 301, 302, 303, 304} & set(ids) and ids.count(1) == 1 and ids.count(5) == 2 and ids.count(7) == 1
    assert {i for i in range(40)} <= set(ids) and ids.count(None) <= 1


def test_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_batches_are_bounded_by_bytes(spark, sf_dir):
    """Workers and executors keep what their largest batch took, so long texts make batches of fewer rows."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(5000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 200) AS text")
    spark.conf.unset(setting)
    try:
        corpus_pipeline.pack(spark, docs.limit(1), sf_dir)
        sizes = docs.mapInArrow(lambda batches: (b.select([0]).slice(0, 1).set_column(0, "n", [b.nbytes]) for b in batches), "n long").collect()
        assert sum(r["n"] for r in sizes) > 5_000_000 and max(r["n"] for r in sizes) < 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(setting, 1 << 16)
        corpus_pipeline.pack(spark, docs.limit(1), sf_dir)
        assert spark.conf.get(setting) == str(1 << 16)  # the user's own bound stays
    finally:
        spark.conf.unset(setting)
