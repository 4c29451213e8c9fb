"""Best-fit packing of tokenized documents into sequences of bounded length.

Every document becomes its token ids and an end id. A longer one is cut into full pieces from its end, so only its
first piece may be short. Pieces are packed by bounded-space online best-fit: a task holds a fixed number of open bins,
found by their free space through a bitset in one integer. A piece goes to the open bin with the least sufficient
space; if none has enough and all bins are in use, the fullest closes first.

Tokenizing and packing are one pass over the documents; only (document, piece, length, bin, offset) is written. At the
end of a task its open bins, at most ``open_bins``, are left. Their pieces are packed again, longest first, by fewer
tasks, each taking the open bins of ``FAN_IN`` tasks, until one task has seen the last of them: a tree in which every
task has a bound, and only open bins move.

Token ids are those of the tokenizer file. As its tokens never cross the bounds of its pre-tokenization, a text of
plain lines of words is cut at its spaces, and each distinct word is encoded once and remembered; other Latin-1 texts
are cut into pre-tokenization units. Units are merged by the ranks read from the file. Texts beyond Latin-1, and those in which an
added token of the file is written out, go to the tokenizer whole.

A null text is empty and still gets its end id. Rows of equal id are packed separately. A null id is kept. Ties of
free space are broken by taking the bin that got this space last. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import stage

#: Tasks whose remaining bins one task packs again.
FAN_IN = 16

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean"

#: The pre-tokenization units of the byte-level vocabulary for texts within Latin-1, where letters,
#: digits and white space are these.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_DIGITS = "0-9²³¹¼½¾"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_UNITS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|"
    rf"[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_LATIN_1 = re.compile(r"[\x00-\xff]*\Z")
#: White space other than one space between words and one line end between lines; such a text is cut into units.
_LOOSE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")
#: Only short words are remembered, and so many of them.
_REMEMBERED_CHARS, _REMEMBERED_WORDS = 32, 300_000


def rank_encoding(path: str):
    """The vocabulary of a byte-level tokenizer file as ranked merges, or None where ids don't follow the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file shows as themselves; others as 256 and on
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if sorted(vocabulary[c] for c in code) != list(range(256)) or [vocabulary[t] for t in merged] != list(range(256, 256 + len(merged))):
        return None
    ranks = {bytes(code[c] for c in t): vocabulary[t] for t in (*code, *merged)}
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = rank_encoding(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _unit(self, unit: str) -> bytes:
        # Merging takes time with the square of a unit's length here, so long ones are left to the tokenizer.
        if self.ranked is None or len(unit) > 256:
            return self.whole(unit)
        return _as_bytes(self.ranked.encode_ordinary(unit))

    def units(self, text: str) -> bytes:
        """Ids of a Latin-1 text by its pre-tokenization units."""
        return b"".join([self._unit(u) for u in _UNITS.findall(text)])

    def ids(self, text: str) -> bytes:
        if not _LATIN_1.match(text) or any(t in text for t in self.added):
            return self.whole(text)
        if any(s in text for s in _LOOSE) or text[:1] in ("", " ", "\n") or text[-1:] in (" ", "\n"):
            return self.units(text)
        # A space belongs to the word after it, a line end is a unit of its own: mark line starts to tell them apart.
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\n" + words[0]
        return _joined(self.words, words, lambda w: self.units(w if w[:1] == "\n" else " " + w))[len(self.newline):]

    @cached_property
    def newline(self) -> bytes:
        return self.units("\n")


def _joined(known: dict[str, bytes], parts: list[str], encode: Callable[[str], bytes]) -> bytes:
    """Ids of all parts; short ones are remembered."""
    try:
        return b"".join([known[p] for p in parts])
    except KeyError:
        if len(known) > _REMEMBERED_WORDS:
            known.clear()
        extra = {}
        for p in parts:
            if p not in known and p not in extra:
                (known if len(p) <= _REMEMBERED_CHARS else extra)[p] = encode(p)
        return b"".join([known[p] if p in known else extra[p] for p in parts])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder of a worker process: its tasks share the vocabulary and the words met."""
    return Encoder(path)


def _as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class OpenBins:
    """At most ``limit`` open bins, by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces = 0  # bit s is set if a bin has s free places
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        chosen = bins.pop()
        if not bins:
            self.spaces &= ~(1 << space)
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            space, chosen = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = space - length
        if left:
            self.by_space[left].append(chosen)
            self.spaces |= 1 << left
        else:
            self.open -= 1
        if self.open > self.limit:
            self._take((self.spaces & -self.spaces).bit_length() - 1)
            self.open -= 1
        return chosen, self.capacity - space

    def remaining(self) -> dict[int, int]:
        """Used places of the bins that are still open."""
        return {b: self.capacity - space for space, bins in enumerate(self.by_space) for b in bins}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones from its end, a shorter one first."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((s, capacity) for s in range(first, length, capacity))]


def _bin_base() -> int:
    return TaskContext.get().partitionId() << 36


def _pack_documents(tokenizer: str, end_id: int, capacity: int, open_bins: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins, base = encoder_of(tokenizer), OpenBins(capacity, open_bins), _bin_base()
        held: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encoder.ids(text.as_py() or "") + end)
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    at, offset = bins.place(length)
                    held.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), at, offset))
            # Rows whose bin is closed can go; at most the contents of the open bins stay.
            remaining = bins.remaining()
            yield _piece_batch([r for r in held if r[5] not in remaining], base, False)
            held = [r for r in held if r[5] in remaining]
        yield _piece_batch(held, base, True)

    return run


def _piece_batch(rows: list[tuple], base: int, still_open: bool) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns[5] = [base + b for b in columns[5]]
    arrays = [pa.array(c, t) for c, t in zip(columns, types)] + [pa.array([still_open] * len(rows), pa.bool_())]
    return pa.record_batch(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "open"])


def _pack_again(capacity: int, open_bins: int, level: int):
    """Pack the pieces of open bins, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), _bin_base() + (level << 58)
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[:7]))]
        rows.sort(key=lambda r: (-r[3], r[5], r[6]))
        placed = [(*r[:5], *bins.place(r[3])) for r in rows]
        remaining = bins.remaining()
        yield _piece_batch([r for r in placed if r[5] not in remaining], base, False)
        yield _piece_batch([r for r in placed if r[5] in remaining], base, True)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, open_bins: int = 512) -> DataFrame:
    """Place of every piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that all executors have.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stage(texts.mapInArrow(_pack_documents(tokenizer, end_id, capacity, open_bins), _PIECES), "pieces")
    tasks = texts.rdd.getNumPartitions()
    done, level = [], 0
    while tasks > 1:
        tasks, level = -(-tasks // FAN_IN), level + 1
        done.append(pieces.where("not open"))
        again = pieces.where("open").coalesce(tasks).mapInArrow(_pack_again(capacity, open_bins, level), _PIECES)
        pieces = stage(again, "pieces")
    return reduce(DataFrame.union, done, pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Token arrays of the packed sequences: (sequence_id, ids). Pieces join their documents by id, which must be unique."""
    end = end_id

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            ids = [memoryview(encoder.ids(t or "") + end.to_bytes(4, "little")).cast("I").tolist() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    tokens = docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<long>")
    return (
        placed.join(tokens, "doc_id")
        .select("sequence_id", F.struct("offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("p"))
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("ids"))
    )
