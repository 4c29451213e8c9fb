"""Personal data by base patterns and a linear-chain conditional random field.

Base spans are the leftmost non-overlapping matches of a pattern per kind, checked by value (octets, digits, Luhn). The
field labels white-space tokens by features of their shape, their make-up, their neighbours' shapes and the words before
them; it is trained on a small labelled table by its exact gradient, and decoded by Viterbi over batches of sequences in
numpy. It adds spans that overlap no base span: phone numbers without a plus sign, addresses with a port, and a kind that
has no base pattern, secrets, that is, keys and passwords behind the word that announces them (column n_secret).

A sequence is a run of tokens within ``REACH`` of a token with a digit or an at sign; all other tokens are of no kind. Every
token of every text is looked at, all of it. Sequences are decoded together as long as their padded places stay under
``CELLS``; a longer one is decoded alone. The fitted weights, which are all that is broadcast, have a fixed size.

Null and empty texts have no spans. Rows of equal id are separate documents. Positions are code points, ends exclusive.
Without labelled rows only base spans are found. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order of output, and their base patterns.
KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: A match begins at the first of a run of digits, so later digits of the run need no try.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Kinds that the field adds to, the last without a base pattern.
ADDED = [*KINDS, "secret"]

REACH = 3
LABELS = ["O", *ADDED]
FEATURES = 1 << 14
#: Padded places of sequences that are decoded together, and places whose weights are summed at once.
CELLS, STEP = 1 << 16, 1 << 14
SECRET = LABELS.index("secret")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, sorted."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:  # from each sign outwards, so that long words without one cost nothing
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, 0, last))
        else:
            # Nothing before this sign can begin a match any more.
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    if _DIGIT.search(text):
        # int() of a long run of digits is slow and over 255 anyway.
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def shape(token: str) -> str:
    """Letters as A and a, digits as 9, runs of over three cut."""
    signs = "".join("9" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    return re.sub(r"(.)\1{3,}", r"\1\1\1", signs)


def make_up(token: str) -> str:
    """Which kinds of characters a token's core has, and about how many: keys mix digits and letters at length."""
    core = token.strip("\"'`.,;:()[]{}<>|")
    kinds = "".join(k for k, found in (("9", re.search(r"\d", core)), ("a", re.search(r"[^\W\d_]", core)), ("_", re.search(r"[^\w]", core))) if found)
    changes = len(re.findall(r"\d(?=[^\W\d_])|[^\W\d_](?=\d)", core))
    return f"{kinds}{len(core).bit_length()}{min(changes, 6)}{'h' if re.fullmatch(r'[0-9a-f]+', core) else ''}"


def features(tokens: list[str]) -> np.ndarray:
    """Feature numbers of every token: own shape and make-up, the neighbours' shapes, the words around it."""
    shapes = ["^", *map(shape, tokens), "$"]
    words = ["^", "^", "^", *(re.sub(r"[\W\d_]+", "", t).lower() for t in tokens), "$"]
    rows = []
    for i, token in enumerate(tokens, 1):
        own, made = shapes[i], make_up(token)
        digits = sum(c.isdigit() for c in token)
        names = ("b", f"s{own}", f"p{shapes[i - 1]}", f"n{shapes[i + 1]}", f"sp{own}|{shapes[i - 1]}", f"sn{own}|{shapes[i + 1]}",
                 f"d{min(digits, 20)}", f"l{min(len(token), 24)}|{digits > 0}", f"@{'@' in token}{token.count('.')}", f"e{own[:2]}|{own[-2:]}",
                 f"m{made}", f"w{words[i + 1]}|{made}", f"v{words[i]}|{made}", f"u{words[i + 1]}|{words[i]}", f"o{words[i + 2]}", f"q{shapes[i - 1]}|{made}",
                 f"k{words[i + 1] or words[i]}|{len(token) >= 14 and digits > 0}")
        rows.append([zlib.crc32(n.encode()) % FEATURES for n in names])
    return np.array(rows, np.int32)


def labelled_examples() -> list[tuple[list[str], list[str]]]:
    """Small labelled table: values of each kind in several forms between plain words, and look-alikes of no kind."""
    r = random.Random(11)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdeéghilmnoöprstu") for _ in range(r.randrange(1, 11))).capitalize() + r.choice(["", "", ",", "."])
    low = lambda: word().lower()
    hexes = lambda k: hashlib.sha512(n(9).encode()).hexdigest()[:k]
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k - 1)) + n(1)
    forms = {
        "email": [lambda: [f"{low().strip('.,')}{n(2)}@mail{n(1)}.example.com"], lambda: [f"{low().strip('.,')}.{low().strip('.,')}@host.org."],
                  lambda: [f"{low().strip('.,')}@[192.168.{n(2)}.{n(2)}]"]],
        "ip": [lambda: [".".join(str(r.randrange(256)) for _ in range(4))], lambda: [".".join(str(r.randrange(256)) for _ in range(4)) + ":8080"]],
        "card": [lambda: [n(4), n(4), n(4), n(4)], lambda: ["-".join(n(4) for _ in range(4))]],
        "phone": [lambda: [f"+{n(1)}", f"({n(3)})", f"{n(3)}-{n(4)}"], lambda: [f"({n(3)})", f"{n(3)}-{n(4)}"], lambda: [f"{n(3)}-{n(3)}-{n(4)}"],
                  lambda: [f"({n(3)}){n(3)}-{n(4)}"], lambda: [f"{n(3)}.{n(3)}.{n(4)}."]],
        "O": [lambda: [f"{hexes(40)}"], lambda: ["commit", hexes(40)], lambda: ["sha256", "=", hexes(r.choice([40, 64]))],
              lambda: [low(), hexes(40), low()], lambda: [f"{r.choice(['md5', 'checksum', 'digest'])}:", hexes(r.choice([32, 40]))],
              lambda: [r.choice(["id", "hash", "rev", "sum"]), "=", hexes(r.choice([32, 40]))], lambda: [f"{low()}{n(3)}"], lambda: [f"{low()}", "=", f'"{low()}"'],
              lambda: ["token", "ring", n(3)], lambda: ["password", "of", f"{n(1)}", "words"], lambda: ["key", "=", n(2)], lambda: ["version", f"{n(1)}.0."], lambda: [n(16)], lambda: [n(r.randrange(1, 13))],
              lambda: [f"{r.randrange(1900, 2030)}."], lambda: [f"{n(1)}.{n(2)}"], lambda: [f"{n(4)}-{n(2)}-{n(2)}"], lambda: ["|", low(), "|"], lambda: ["@", low()],
              lambda: [f"@{low()}"], lambda: [f"{n(2)}%"], lambda: [n(4), n(16)], lambda: [n(16), n(16)], lambda: [f"{n(1)}.{n(1)}.{n(1)}"], lambda: [f"{n(2)}:{n(2)}"]],
    }
    names = ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_token", "client_secret", "key"]
    values = [lambda: hexes(40), lambda: hexes(32), lambda: mixed(20), lambda: mixed(32), lambda: f"sk-{mixed(24)}", lambda: f"AKIA{mixed(16).upper()}"]
    rows = []
    for _ in range(30):
        for kind, makers in forms.items():
            for make in makers:
                value = make()
                before, after = [low() for _ in range(r.randrange(4))], [low() for _ in range(r.randrange(4))]
                rows.append((before + value + after, ["O"] * len(before) + [kind] * len(value) + ["O"] * len(after)))
        for make in values * 3:
            name, value, quote = r.choice(names), make(), r.choice(['"', "'", ""])
            name = name.upper() if r.random() < 0.2 else name
            quoted = f"{quote}{value}{quote}{r.choice(['', '', ',', ';', '.'])}"
            written, tags = r.choice([([name, "=", quoted], "OOS"), ([name, "=", quoted], "OOS"), ([f"{name}:", quoted], "OS"), ([f"{name}={quoted}"], "S")])
            before, after = [word() for _ in range(r.randrange(4))], [word() for _ in range(r.randrange(4))]
            rows.append((before + written + after, ["O"] * len(before) + ["secret" if t == "S" else "O" for t in tags] + ["O"] * len(after)))
    r.shuffle(rows)
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_examples(), "tokens array<string>, tags array<string>")


class Field:
    """Weights of the field: features by label, and label by next label."""

    def __init__(self):
        self.weights = np.zeros((FEATURES, len(LABELS)), np.float32)
        self.steps = np.zeros((len(LABELS), len(LABELS)), np.float32)

    def scores(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Padded token scores (sequence, place, label) and lengths."""
        lengths = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), lengths.max(), len(LABELS)), np.float32)
        flat = np.concatenate(sequences)
        summed = np.concatenate([self.weights[flat[i : i + STEP]].sum(axis=1) for i in range(0, len(flat), STEP)])
        out[np.arange(lengths.max()) < lengths[:, None]] = summed
        return out, lengths

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of every sequence by Viterbi, all sequences at once."""
        if not sequences:
            return []
        scores, lengths = self.scores(sequences)
        best, back = scores[:, 0].copy(), np.zeros(scores.shape, np.int8)
        for t in range(1, scores.shape[1]):
            through = best[:, :, None] + self.steps
            go = t < lengths
            back[:, t] = through.argmax(axis=1)
            best[go] = through.max(axis=1)[go] + scores[go, t]
        out, label = np.zeros(scores.shape[:2], np.int8), best.argmax(axis=1)
        for t in reversed(range(scores.shape[1])):
            inside = t < lengths
            out[inside, t] = label[inside]
            label = np.where(inside & (t > 0), back[np.arange(len(label)), t, label], label)
        return [row[:n] for row, n in zip(out, lengths)]

    def fit(self, rows: list[tuple[list[str], list[str]]], rounds: int = 120, rate: float = 0.4, decay: float = 1e-3) -> Field:
        """Maximise the regularised likelihood by its exact gradient (forward-backward), step sizes by past gradients."""
        rows = [r for r in rows if r[0]]
        if not rows:
            return self
        sequences = [features(t) for t, _ in rows]
        n = len(rows)
        tags = np.zeros((n, max(map(len, sequences))), np.int64)
        for i, (_, t) in enumerate(rows):
            tags[i, : len(t)] = [LABELS.index(x) for x in t]
        flat = np.concatenate(sequences)
        past_w, past_s = np.full_like(self.weights, 1e-6), np.full_like(self.steps, 1e-6)
        for _ in range(rounds):
            scores, lengths = self.scores(sequences)
            inside = np.arange(scores.shape[1]) < lengths[:, None]
            ahead = np.zeros(scores.shape, np.float64)
            ahead[:, 0] = scores[:, 0]
            for t in range(1, scores.shape[1]):
                ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.steps, axis=1) + scores[:, t]
            behind = np.zeros_like(ahead)
            for t in reversed(range(scores.shape[1] - 1)):
                through = np.logaddexp.reduce(self.steps + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where(inside[:, t + 1, None], through, 0)
            total = np.logaddexp.reduce(ahead[:, 0] + behind[:, 0], axis=1)
            miss = -np.exp(np.minimum(ahead + behind - total[:, None, None], 0))
            np.put_along_axis(miss, tags[:, :, None], np.take_along_axis(miss, tags[:, :, None], 2) + 1, 2)
            gradient = np.zeros_like(self.weights)
            np.add.at(gradient, flat, np.repeat(miss[inside].astype(np.float32)[:, None, :], flat.shape[1], axis=1))
            pairs = inside[:, 1:]
            joint = ahead[:, :-1, :, None] + self.steps + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
            moves = -np.exp(np.minimum(joint, 0))[pairs].sum(axis=0)
            np.add.at(moves, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
            for own, past, g in ((self.weights, past_w, gradient / n), (self.steps, past_s, moves.astype(np.float32) / n)):
                g = g - decay * own / n
                past += g * g
                own += rate * g / np.sqrt(past)
        return self


_TOKEN = re.compile(r"\S+")


def sequences_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of token ranges near a token with a digit or an at sign."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    ranges = [m.span() for m in _TOKEN.finditer(text)]
    signal = [i for i, (a, b) in enumerate(ranges) if text.find("@", a, b) >= 0 or _DIGIT.search(text, a, b)]
    out, end = [], 0
    for i in signal:
        low, high = max(0, i - REACH), min(len(ranges), i + REACH + 1)
        if out and low <= end:
            out[-1].extend(ranges[end:high])
        else:
            out.append(ranges[low:high])
        end = max(end, high)
    return out


def added_spans(text: str, ranges: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one label, without outer punctuation, that hold as many digits as their kind needs."""
    out, i = [], 0
    while i < len(ranges):
        kind, j = int(labels[i]), i
        while j < len(ranges) and labels[j] == kind:
            j += 1
        if kind:
            start, end = ranges[i][0], ranges[j - 1][1]
            while end > start and not (text[end - 1].isalnum() or text[end - 1] in "])"):
                end -= 1
            while start < end and not (text[start].isalnum() or text[start] in "(+"):
                start += 1
            digits = len(_DIGIT.findall(text, start, end))
            if kind == SECRET:
                # The value alone, without the name and the sign before it; shorter ones announce nothing.
                start += len(re.match(r"(?:\w+[:=]+[\"']?)?", text[start:end])[0])
                valid = end - start >= 12
            else:
                valid = "@" in text[start:end] if kind == 1 else {2: 4, 3: 14, 4: 7}[kind] <= digits <= {2: 12, 3: 19, 4: 15}[kind]
            if valid:
                out.append((start, kind - 1, end))
        i = j
    return out


def _together(owners: list[tuple[int, list]]) -> Iterator[list[tuple[int, list]]]:
    """Runs of (owner, places), sorted by length, of at most ``CELLS`` padded places (or one alone)."""
    group: list = []
    for owner in owners:
        if group and (len(group) + 1) * len(owner[1]) > CELLS:
            yield group
            group = []
        group.append(owner)
    if group:
        yield group


def find_personal_data(docs: DataFrame, labelled: DataFrame, max_labelled: int = 10_000) -> DataFrame:
    """Per row: doc_id, base counts, n_secret, base_sha256 and all spans. At most ``max_labelled`` labelled rows are used."""
    field = Field().fit([(r["tokens"], r["tags"]) for r in labelled.select("tokens", "tags").limit(max_labelled).collect()])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def written(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{ADDED[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                owners = [(i, ranges) for i, t in enumerate(texts) for ranges in sequences_of(t)]
                found: list[list] = [[] for _ in texts]
                # Sequences of like length together, so that little is padding.
                owners.sort(key=lambda o: len(o[1]))
                for own in _together(owners):
                    labels = shared.value.decode([features([texts[i][a:b] for a, b in ranges]) for i, ranges in own])
                    for (i, ranges), found_labels in zip(own, labels):
                        if found_labels.any():
                            found[i] += [s for s in added_spans(texts[i], ranges, found_labels)
                                         if all(s[2] <= a or b <= s[0] for a, _, b in base[i])]
                counts = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(len(KINDS))]
                counts.append([sum(k == SECRET - 1 for _, k, _ in spans) for spans in found])
                hashes = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
                spans = [written(sorted(b + f)) for b, f in zip(base, found)]
                yield pa.record_batch(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in ADDED), "base_sha256", "spans"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, base_sha256 string, spans string")
