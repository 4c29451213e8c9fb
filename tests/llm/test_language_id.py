"""Language ID: held-out accuracy and edge cases."""

import random

from pyspark.sql import functions as F

from dayspan.llm.language_id import fit_dictionaries, language_scores
from dayspan.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    found = QUERIES["op3_compression_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.95 * len(held)
    assert sum(r["rejected"] for r in rows) < 0.02 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "der die das und nicht ein " * 40, "de"), (2, "the of and not with a " * 40, "en"), (3, "42 -- !!", None), (4, None, "xx"),
            (5, "", ""), (6, "the of and not with a " * 3, None), (6, "the of and not with a " * 3, None), (None, "der die das und nicht ein " * 3, None), (7, "the " * 100000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source double")
    got = language_scores(docs, docs).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [r["lang_pred"] for r in got] == ["de", "en", "und", "und", "und", "en", "en", "de", "en"]
    assert [r["rejected"] for r in got][2:5] == [True] * 3
    assert list(fit_dictionaries(docs)) == ["de", "en"]


def test_a_rare_label_leaves_the_others_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-1, "a zz", "xx"), (-2, "zul zulu ngiyabonga kakhulu sawubona unjani " * 9, "zu")], docs.schema)

    def accuracy(labelled):
        rows = language_scores(docs, labelled).collect()
        return sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows), sum(r["rejected"] for r in rows) / len(rows)

    alone, with_rare = accuracy(docs), accuracy(docs.union(rare))
    assert with_rare[0] >= alone[0] - 0.002 and with_rare[1] <= alone[1] + 0.002
    dictionaries = fit_dictionaries(docs.union(rare))
    assert len(dictionaries["zu"]) < len(dictionaries["en"]) == len(fit_dictionaries(docs)["en"])
    own = spark.createDataFrame([(1, "sawubona unjani zulu ngiyabonga kakhulu zul " * 4, None)], docs.schema)
    assert language_scores(own, docs.union(rare)).first()["lang_pred"] == "zu"


def test_many_labels_are_all_learned(spark):
    r = random.Random(5)
    words = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for _ in range(260)]
    rows = [(i, " ".join(r.choice(words[i]) for _ in range(80)), f"l{i}") for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(fit_dictionaries(docs)) == 260
    some = [(i, " ".join(r.choice(words[i]) for _ in range(40)), f"l{i}") for i in range(0, 260, 13)]
    got = language_scores(spark.createDataFrame(some, docs.schema), docs).collect()
    assert all(row["lang_pred"] == row["lang"] for row in got)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "der die das und nicht ein " * 9, "de"), (2, "the of and not with a " * 9, "en")], "doc_id long, text string, lang string")
    extra = {c: F.lit(c) for c in ("score", "rejected", "lang_pred", "_letters", "a`b", "n")}
    wide = docs.withColumns(extra)
    got = language_scores(wide, wide)
    assert got.columns == ["doc_id", "text", "lang", "_letters", "a`b", "n", "lang_pred", "score", "rejected"]
    assert [r["lang_pred"] for r in got.collect()] == ["de", "en"]
    named = language_scores(wide, wide, prefix="p_")
    assert named.columns[:-3] == wide.columns and named.first()["score"] == "score"


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[3:] for r in language_scores(docs, docs).collect()] == [("und", 0.0, True)]
    assert language_scores(docs.limit(0), docs.limit(0)).collect() == []


def test_ties_are_rejected(spark):
    docs = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    got = language_scores(docs, docs).collect()
    assert {(r["lang_pred"], r["rejected"]) for r in got} == {("a", True)}
