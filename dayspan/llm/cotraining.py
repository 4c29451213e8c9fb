"""Quality classification by co-training on two views of a document.

The content view holds hashed words and shares of character classes; the metadata view holds source, language and
length and layout of the page (lines, words per line, characters per word). Each view has a logistic classifier. In every
round a classifier's most confident pseudo-labels for unlabelled documents, as many of each class as the labels' shares
ask for, are given to the other one. The views are then calibrated on labelled documents that no round has used, and
combined by a logistic model on their calibrated log-odds. All documents are scored.

The fit uses at most ``max_labelled`` labelled and ``max_unlabelled`` other documents, chosen by a hash of their id against
a threshold from the table's counts; only their features reach the driver, ``WIDTH`` numbers each. The weights that are
broadcast have a fixed size.

Null and empty texts have the features of no words and are scored. Repeated label rows of an id count once, by the larger
label; null labels aren't used. Without labels of both classes the score is the share of good labels, or 0.5. Rows of
equal id and text get equal scores. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import NOT_SPACE, byte_class, mix, text_slices, words_of

WORDS, CLASSES = 512, 6
CONTENT = WORDS + CLASSES
#: Hashed source and language, and buckets of four sizes.
SOURCES, BUCKETS = 64, 16
METADATA = 2 * SOURCES + 4 * BUCKETS
WIDTH = CONTENT + METADATA

_CHARACTERS = [byte_class(bytes(range(ord("a"), ord("z") + 1))), byte_class(bytes(range(ord("A"), ord("Z") + 1))), byte_class(b"0123456789"),
               byte_class(b"#*$%&|<>=_~^"), byte_class(b".,;:!?"), byte_class(bytes(range(128, 256)))]


def view_features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, features) of runs of rows: the content view's columns, then the metadata view's."""
    named = [np.array([hash_name(v) % SOURCES for v in batch.column(c).to_pylist()], np.int64) for c in ("source", "lang")]
    for first, end, data, offsets in text_slices(batch):
        n = end - first
        words = words_of(data, offsets, NOT_SPACE)
        counts = np.diff(words.first)
        row = np.repeat(np.arange(n), counts)
        bags = np.bincount(row * WORDS + (mix(words.hashes) % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        bags = np.log1p(bags.astype(np.float32))
        bags /= np.maximum(np.linalg.norm(bags, axis=1, keepdims=True), 1)
        size = np.maximum(np.diff(offsets), 1)
        out = np.zeros((n, WIDTH), np.float32)
        out[:, :WORDS] = bags
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
        for i, table in enumerate(_CHARACTERS):
            out[:, WORDS + i] = np.sqrt(sums(table[data]) / size)
        lines = sums(data == 10) + 1
        sizes = (size, lines, counts / lines * 4, np.diff(offsets) / np.maximum(counts, 1) * 64)
        columns = [h[first:end] + i * SOURCES for i, h in enumerate(named)]
        columns += [np.minimum(np.log2(s + 1).astype(np.int64), BUCKETS - 1) + 2 * SOURCES + i * BUCKETS for i, s in enumerate(sizes)]
        for column in columns:
            out[np.arange(n), CONTENT + column] = 1
        yield first, end, out


def hash_name(value) -> int:
    data = np.frombuffer(b"\x00" if value is None else b"\x01" + str(value).encode(), np.uint8)
    total = np.uint64(14695981039346656037)
    with np.errstate(over="ignore"):
        for b in data:
            total = (total ^ np.uint64(b)) * np.uint64(1099511628211)
    return int(total >> np.uint64(20))


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, importance: np.ndarray | None = None, decay: float = 1e-4, rounds: int = 300) -> Logistic:
        """Penalised likelihood by accelerated gradient steps."""
        share = np.ones(len(y)) if importance is None else importance
        share = (share / share.sum()).astype(np.float32)
        own = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        w, ahead = np.zeros(own.shape[1], np.float32), np.zeros(own.shape[1], np.float32)
        step = 4 / float((share[:, None] * own * own).sum())
        for i in range(rounds):
            miss = 1 / (1 + np.exp(-np.clip(own @ ahead, -30, 30))) - y
            new = ahead - step * (own.T @ (share * miss) + decay * ahead)
            ahead, w = new + i / (i + 3) * (new - w), new
        return Logistic(w[:-1], float(w[-1]))


@dataclass
class Model:
    """Both views' classifiers, their calibration and the combination."""

    views: list[Logistic]
    calibration: list[Logistic]
    combined: Logistic
    prior: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        sides = (x[:, :CONTENT], x[:, CONTENT:])
        odds = [c.odds(v.odds(s)[:, None]) for v, c, s in zip(self.views, self.calibration, sides)]
        return 1 / (1 + np.exp(-np.clip(self.combined.odds(np.stack(odds, axis=1)), -30, 30)))


def co_train(x: np.ndarray, y: np.ndarray, pool: np.ndarray, rounds: int = 4, share: float = 0.05) -> Model:
    """Fit on labelled (x, y) and unlabelled ``pool`` features. Every fifth labelled row is kept for calibration."""
    if len(np.unique(y)) < 2 or len(y) < 20:
        return Model([], [], None, float(y.mean()) if len(y) else 0.5)
    kept = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[kept])) < 2 or len(np.unique(y[~kept])) < 2:
        kept = np.zeros(len(y), bool)
    fit_x, fit_y = x[~kept], y[~kept]
    sides = (slice(0, CONTENT), slice(CONTENT, WIDTH))
    good = float(fit_y.mean())
    pseudo = [np.full(len(pool), -1.0) for _ in sides]  # labels that each view has been given
    views = []
    for _ in range(rounds + 1):
        views = []
        for own, given in zip(sides, pseudo):
            some = given >= 0
            labels = np.concatenate([fit_y, given[some]])
            trust = np.concatenate([np.ones(len(fit_y)), np.full(int(some.sum()), 0.5)])
            views.append(Logistic.fit(np.concatenate([fit_x[:, own], pool[some][:, own]]), labels, trust))
        if not len(pool):
            break
        for teacher, student in ((0, 1), (1, 0)):
            odds = views[teacher].odds(pool[:, sides[teacher]])
            free = np.flatnonzero(pseudo[student] < 0)
            order = free[np.argsort(odds[free], kind="stable")]
            low, high = int(len(pool) * share * (1 - good)), int(len(pool) * share * good)
            for chosen, label in ((order[:low], 0.0), (order[len(order) - high :], 1.0)):
                sure = chosen[odds[chosen] < -1] if label == 0 else chosen[odds[chosen] > 1]
                pseudo[student][sure] = label
    test_x, test_y = (x[kept], y[kept]) if kept.any() else (x, y)
    raw = [v.odds(test_x[:, s]) for v, s in zip(views, sides)]
    calibration = [Logistic.fit(r[:, None].astype(np.float32), test_y, decay=1e-3) for r in raw]
    odds = np.stack([c.odds(r[:, None]) for c, r in zip(calibration, raw)], axis=1).astype(np.float32)
    return Model(views, calibration, Logistic.fit(odds, test_y, decay=1e-3))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 4000, max_unlabelled: int = 4000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): doc_id, score (0 to 1, high is good) and good (score of 0.5 or more)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    n_known, n_docs = known.count(), docs.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    labelled = known.where(place * n_known < max_labelled).orderBy(place).limit(max_labelled)
    # The share of other documents is taken so that about max_unlabelled are left, and a limit bounds them.
    sample = texts.where(place * n_docs < max_unlabelled + max_labelled).join(known.select("doc_id"), "doc_id", "left_anti").limit(max_unlabelled)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, x in view_features(batch):
                packed = pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())
                yield pa.record_batch([batch.column("doc_id").slice(first, end - first), batch.column("y").slice(first, end - first), packed], names=["doc_id", "y", "x"])

    chosen = texts.join(F.broadcast(labelled), "doc_id").dropDuplicates(["doc_id"]).unionByName(sample.withColumn("y", F.lit(None).cast("double")))
    got = chosen.mapInArrow(rows, "doc_id long, y double, x binary").orderBy("doc_id").toArrow()
    y = got.column("y").to_numpy()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    has = ~np.isnan(y)
    model = docs.sparkSession.sparkContext.broadcast(co_train(x[has], y[has].astype(np.float32), x[~has]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, x in view_features(batch):
                score = model.value.score(x).astype(np.float64)
                yield pa.record_batch([batch.column("doc_id").slice(first, end - first), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "score", "good"])

    return texts.mapInArrow(scored, "doc_id long, score double, good boolean")
