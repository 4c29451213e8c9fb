"""Language ID by compression.

Every language gets a zstandard raw-content dictionary: excerpts of a bounded, hash-chosen sample of its labelled
documents. A text is cut into blocks, each block is compressed with every dictionary, and the language whose dictionary
gives the fewest bytes in sum is predicted. ``score`` is the relative saving over the runner-up; a text whose saving is
below ``margin`` is rejected, as are texts without a letter (language ``und``).

A larger dictionary would win by its size alone, so only dictionaries of equal size are compared. A language's size is
the largest power of two that its excerpts fill. The largest size decides first; then, size by size, the languages that
have only so much challenge the winner: they must beat its dictionary cut to their size, by the margin, and also the
whole of it, as small dictionaries are close to chance. So a rare label neither shrinks the dictionaries of the others
nor goes unlearned.

Texts and dictionaries are lower case, with one space for any run of other characters than letters. Whole bytes are a
coarse measure, so every text is measured in two forms in one stream: as it is, and without each word's first letter.
Blocks keep a dictionary's share in the result alike for short and long texts.

The fit sees about ``sample_docs`` excerpts of ``excerpt`` characters for all languages together (at least one of each),
and dictionaries take ``total_bytes`` (at least ``LEAST`` bytes of each), which is all that reaches the driver or is
broadcast. Prediction reads whole texts.

Null or empty text: ``und``, score 0, rejected. Labels null or empty are not learned; without labels all is ``und``.
Ties take the alphabetically first language and are rejected. Extra columns pass through; one named like a result
column is replaced by it (``prefix`` names the results apart).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayspan.llm.common import map_by_place, stage, unused

BLOCK, LEVEL = 2048, 6
#: Bounds of a dictionary's bytes.
LEAST, MOST = 8, 1 << 17
_OTHERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def fit_dictionaries(labelled: DataFrame, sample_docs: int = 2048, excerpt: int = 400, total_bytes: int = 1 << 24) -> dict[str, bytes]:
    """Dictionary data of each label of ``labelled`` (text, lang); its length is a power of two.

    Documents are chosen by a hash of their text against a threshold from the label's count, so no label's rows are
    brought together. Excerpts come from a hashed place of the text.
    """
    usable = labelled.where("lang is not null and lang <> ''").where(F.col("text").rlike(r"\p{L}"))
    counts = stage(usable.groupBy("lang").count(), "labels")
    n = counts.count()
    if not n:
        return {}
    each = max(1, sample_docs // n)
    place = F.pmod(F.xxhash64("text", F.lit(7)), F.greatest(F.length("text") - excerpt, F.lit(1))).cast("int")
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    sample = (
        usable.select("lang", share.alias("at"), F.substring("text", place + 1, F.lit(excerpt)).alias("excerpt"))
        .join(counts, "lang").where((F.col("at") * F.col("count") < 1.5 * each + 8))
        .select("lang", "at", "excerpt").distinct()
    )
    excerpts: dict[str, list[tuple[float, str]]] = {}
    for row in sample.collect():
        excerpts.setdefault(row["lang"], []).append((row["at"], row["excerpt"]))
    most = max(LEAST, min(MOST, total_bytes // n))
    out = {}
    for lang, rows in sorted(excerpts.items()):
        data = "".join(two_forms(plain_words(t)) for _, t in sorted(rows)[:each]).encode()
        size = min(1 << len(data).bit_length() - 1, 1 << most.bit_length() - 1)
        if size >= LEAST:
            out[lang] = data[-size:]
    return out


def plain_words(text: str) -> str:
    return f" {_OTHERS.sub(' ', text.lower()).strip()} "


def two_forms(words: str) -> str:
    return words + " ".join(w[1:] for w in words.split() if len(w) > 1) + " "


class Scorer:
    def __init__(self, dictionaries: dict[str, bytes], margin: float):
        self.dictionaries, self.margin = dictionaries, margin
        self.by_size: dict[int, list[str]] = {}
        for lang, data in dictionaries.items():
            self.by_size.setdefault(len(data), []).append(lang)
        self.order = sorted(self.by_size, reverse=True)
        self.compressors: dict[tuple[str, int], object] = {}

    def _bytes(self, blocks: list[bytes], lang: str, size: int) -> int:
        """Bytes of the blocks under the last ``size`` bytes of a language's dictionary."""
        if (lang, size) not in self.compressors:
            self.compressors[lang, size] = _compressor(self.dictionaries[lang][-size:], LEVEL)
        compress = self.compressors[lang, size].compress
        return sum(len(compress(b)) for b in blocks)

    def __call__(self, text: str | None, letters: bool) -> tuple[str, float, bool]:
        if not text or not letters or not self.order:
            return UNKNOWN, 0.0, True
        data = two_forms(plain_words(text)).encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        winner, score, whole = None, 1.0, 0
        for size in self.order:
            found = sorted((self._bytes(blocks, lang, size), lang) for lang in self.by_size[size])
            best, lang = found[0]
            if winner is not None:
                found = sorted([*found, (self._bytes(blocks, winner, size), winner)])
            saving = (found[1][0] - found[0][0]) / found[1][0] if len(found) > 1 else 1.0
            if winner is None or (found[0][1] == lang and saving >= self.margin and best < whole):
                winner, score, whole = lang, saving, best
        return winner, score, score < self.margin


def _compressor(data: bytes, level: int):
    import zstandard

    own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False)


def language_scores(docs: DataFrame, labelled: DataFrame, margin: float = 0.004, prefix: str = "", **sample) -> DataFrame:
    """``docs`` with lang_pred, score and rejected as last columns; labels come from ``labelled`` (text, lang) only."""
    results = [f"{prefix}{name}" for name in ("lang_pred", "score", "rejected")]
    docs = docs.drop(*results)
    dictionaries = docs.sparkSession.sparkContext.broadcast(fit_dictionaries(labelled.select("text", "lang"), **sample))
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(dictionaries.value, margin)
        for batch in batches:
            texts, letters = batch.column(at), batch.column(width).to_pylist()
            found = [scorer(t.as_py(), bool(has)) for t, has in zip(texts, letters)]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.record_batch(
                [*batch.columns[:width], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names[:width], *results],
            )

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(results, kinds)]])
    letters = F.col("text").rlike(r"\p{L}").alias(unused("letters", docs.columns))
    return map_by_place(docs.select("*", letters), run, schema)
