"""Quality rules on lines that many documents of a host share, with DataFrame functions only.

Lines are normalised (lower case, white space runs to one space, trimmed) and hashed; documents are counted per host and
hash, each document once. Lines in more than ``max_docs`` documents of their host are removed, and a document that keeps
less than ``least_share`` percent of its words, or none, is rejected. Before that, base rules on the document alone apply.

The counts are partially aggregated, so a line or a host that fills a third of the table is one row of each task. Line
occurrences meet the frequent lines in an equi-join that adaptive execution can split; no text is shuffled.

Every row is a document. Rows equal in id and text get equal results. A null text has no words and fails. A null host is
a host of its own. Lines without a word are never counted or removed. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space parts words; these characters are symbols.
SPACES = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))

    def places(found: Column) -> Column:
        """Starts of windows that have an equal one, in order: equal hashes are neighbours once sorted."""
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(placed, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(
            (x["h"] == F.get(s, j - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - p, F.lit(size)))), F.lit(0), lambda a, b: a + b
        )

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(places(h), covered)))


def base_rules(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    counts = _let(words_of(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), repeated_window_words(w).cast("bigint").alias("n_repeat_words")))
    return _let(counts, lambda c: F.struct(
        c["n_words"].alias("n_words"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        c["n_repeat_words"].alias("n_repeat_words"),
        ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).alias("base_failed"),
    ))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def _lines(docs: DataFrame, host: str) -> DataFrame:
    """(doc_id, text_hash, host, line number, line hash, words) of every line with a word."""
    line = normalised(F.col("line"))
    return (
        docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col(host).alias("host"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
        .where(F.col("line").rlike(r"[^ \t-\r]"))
        .select("doc_id", "text_hash", "host", "no", F.xxhash64(line).alias("h"), (F.length(line) - F.length(F.translate(line, " ", "")) + 1).cast("bigint").alias("words"))
    )


def frequent_lines(docs: DataFrame, host: str = "source", max_docs: int = 20) -> DataFrame:
    """(host, h, n_docs) of the lines in more than ``max_docs`` documents of a host."""
    once = F.array_distinct(F.transform(
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")), lambda x: F.xxhash64(normalised(x))))
    return (
        docs.select(F.col(host).alias("host"), F.explode(once).alias("h"))
        .groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    )


def judge_by_lines(docs: DataFrame, host: str = "source", max_docs: int = 20, least_share: int = 50) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, n_lines_removed and n_words_left."""
    often = frequent_lines(docs, host, max_docs).select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    removed = (
        _lines(docs, host).join(often, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")))
        # A set of line numbers, so that rows equal in id and text count once.
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("host").alias("_of"))
        .agg(F.collect_set(F.struct("no", "words")).alias("gone"))
        .select("_id", "_hash", "_of", F.size("gone").alias("lines"), F.aggregate("gone", F.lit(0).cast("bigint"), lambda n, x: n + x["words"]).alias("gone"))
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col(host).alias("host"), base_rules(F.col("text")).alias("b"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & F.col("host").eqNullSafe(F.col("_of"))
    left = F.col("b.n_words") - F.coalesce("gone", F.lit(0))
    enough = (left > 0) & (100 * left >= least_share * F.col("b.n_words"))
    return rows.join(removed, own, "left").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "b.*", (~F.col("b.base_failed") & enough).alias("kept"),
        F.coalesce("lines", F.lit(0)).cast("bigint").alias("n_lines_removed"), left.alias("n_words_left"),
    )


def without_frequent_lines(docs: DataFrame, host: str = "source", max_docs: int = 20) -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text``."""
    often = frequent_lines(docs, host, max_docs).select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    found = (
        _lines(docs, host).join(often, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("host").alias("_of"))
        .agg(F.collect_set("h").alias("_gone"))
    )
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")) & F.col(host).eqNullSafe(F.col("_of"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_gone", F.xxhash64(normalised(x)))), "\n")
    return docs.join(found, own, "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
