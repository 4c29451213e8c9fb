"""Co-training: held-out separation, calibration and edge cases."""

import numpy as np

from dayspan.llm.cotraining import CONTENT, WIDTH, Logistic, co_train, quality_scores


def separation(scores, y):
    good, bad = scores[y == 1], scores[y == 0]
    return (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()


def test_held_out_separation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = quality_scores(docs, seen).join(held, "doc_id").select("score", "quality").toPandas()
    assert separation(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.9
    assert abs(rows["score"].mean() - rows["quality"].mean()) < 0.06


def test_pseudo_labels_help_the_weaker_view():
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 2400).astype(np.float32)
    x = r.normal(size=(2400, WIDTH)).astype(np.float32) * 0.1
    x[:, 0] += 2 * y - 1
    x[:, CONTENT + np.arange(40)] += (2 * y[:, None] - 1) * r.normal(0.3, 1, (2400, 40)).astype(np.float32) * 0.2
    few = co_train(x[:60], y[:60], x[60:1200])
    alone = Logistic.fit(x[:60, CONTENT:], y[:60])
    taught = few.views[1].odds(x[1200:, CONTENT:])
    assert separation(taught, y[1200:]) >= separation(alone.odds(x[1200:, CONTENT:]), y[1200:]) - 0.01
    assert separation(few.score(x[1200:]), y[1200:]) > 0.95


def test_edges(spark):
    rows = [(i, ("clean words of prose here " * (i % 7 + 1)) if i % 2 else "#### $$$ %%% | | |", "en", "s") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "", ""), (102, "é" * 100000, "en", "s"), (7, rows[7][1], "en", "s"), (None, "text", "en", "s")]
    docs = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, lang string, source string, y int, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (5, None), (None, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["good"] == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).collect() == []
