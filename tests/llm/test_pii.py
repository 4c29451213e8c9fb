"""Personal data: base patterns against plain regular expressions, the field against enumeration, edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np

from dayspan.llm.pii import FEATURES, LABELS, Field, base_spans, find_personal_data, labelled_examples, labelled_table, luhn


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(1)
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    pieces = ["@", ".", "a", "b1", "+1", " ", "-", "(", ")", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "000", "x@y.z", "a.b@c-d.e.f", "é", "\n", "9"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert base_spans(text) == plain(text), text
    for text in ("a" * 200000, "1" * 200000, "@" * 50000, "1." * 50000, "+1" + "(" * 50000, "a@" * 30000, "a" * 100000 + "@"):
        base_spans(text)


def test_decoding_finds_the_best_labels():
    r = np.random.default_rng(2)
    field = Field()
    field.weights[:] = r.normal(size=field.weights.shape)
    field.steps[:] = r.normal(size=field.steps.shape)
    sequences = [r.integers(0, FEATURES, (n, 3)) for n in (1, 4, 2, 5)]
    for s, got in zip(sequences, field.decode(sequences)):
        own = field.weights[s].sum(axis=1)
        score = lambda y: sum(own[i, a] for i, a in enumerate(y)) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(got) == max(itertools.product(range(len(LABELS)), repeat=len(s)), key=score)


def test_held_out_examples():
    from dayspan.llm.pii import features

    rows = labelled_examples()
    field = Field().fit(rows[::2])
    got = field.decode([features(t) for t, _ in rows[1::2]])
    right = [LABELS[g] == w for labels, (_, tags) in zip(got, rows[1::2]) for g, w in zip(labels, tags)]
    assert sum(right) > 0.97 * len(right)


def test_added_spans_and_edges(spark):
    texts = ["call (415) 555-2671 now", "mail a.b@c.org or +1 (017) 555-7713 to", None, "", "version 2.0. of 1234567890123456 words", "no data at all here",
             'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "x" * 300000 + " 1"]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, "", "s", 1), (None, "é 10.0.0.1", "s", 1)], "doc_id long, text string, spans string, n_ip int")
    rows = find_personal_data(docs, labelled_table(spark)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10
    assert got[0]["spans"] == "phone:5:19" and got[0]["n_phone"] == 0
    assert got[1]["spans"] == "email:5:14,phone:18:35" and (got[1]["n_email"], got[1]["n_phone"]) == (1, 1)
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:5:14,phone:18:35").hexdigest()
    assert all(got[i]["spans"] == "" for i in (2, 3, 4, 5, 7)) and got[None]["spans"] == "ip:2:10"
    assert got[6]["spans"] == "secret:9:49" and got[6]["n_secret"] == 1 and got[6]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert find_personal_data(docs.limit(0), labelled_table(spark).limit(0)).collect() == []


def test_recall_and_precision_by_kind_on_documents(spark):
    """Every planted secret of the documents, and hardly anything else; other kinds come from the base patterns."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = find_personal_data(docs, labelled_table(spark)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {(r["doc_id"], s) for r in rows for s in r["spans"].split(",") if s.startswith("secret")}
    real = {(i, f"secret:{m.start(1)}:{m.end(1)}") for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert len(real) > 5 and len(found & real) >= 0.9 * len(real) and len(found & real) >= 0.9 * len(found)
    base = sum(r[f"n_{k}"] for r in rows for k in ("email", "ip", "card", "phone"))
    others = sum(len([s for s in r["spans"].split(",") if s and not s.startswith("secret")]) for r in rows)
    assert base <= others <= 1.05 * base + 2


def test_recall_by_kind_on_new_examples():
    """Held-out secrets in running text, each form; look-alikes without an announcing word are left alone."""
    from dayspan.llm.pii import added_spans, features, sequences_of

    field, r = Field().fit(labelled_examples()), random.Random(77)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def secrets(text):
        out = []
        for ranges in sequences_of(text):
            (labels,) = field.decode([features([text[a:b] for a, b in ranges])])
            out += [text[a:b] for a, k, b in added_spans(text, ranges, labels) if LABELS[k + 1] == "secret"]
        return out

    forms = ['the quick token = "{0}" jumps over', "set password: {0} and go", "export API_KEY={0} now", "client_secret = '{0}', next", "uses secret = {0} for it"]
    for form in forms:
        values = [hexes(40) for _ in range(50)]
        assert sum(secrets(form.format(v)) == [v] for v in values) >= 45, form
    plain = ["see commit {0} for it", "it is {0} there", "the sum sha256 = {0} is right"]
    assert sum(secrets(form.format(hexes(40))) == [] for form in plain for _ in range(30)) >= 81


def test_a_million_digit_tokens_fit_in_memory(spark):
    import tracemalloc

    from dayspan.llm.pii import _together

    owners = sorted([(i, [(0, 1)] * n) for i, n in enumerate([3] * 300 + [200_000])], key=lambda o: len(o[1]))
    groups = list(_together(owners))
    assert sum(map(len, groups)) == 301 and all(len(g) * len(g[-1][1]) <= 1 << 16 or len(g) == 1 for g in groups)
    tracemalloc.start()
    Field().decode([np.zeros((200_000, 16), np.int32)])
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    docs = spark.createDataFrame([(1, "7 " * 60_000)] + [(i, "a 7") for i in range(2, 300)], "doc_id long, text string")
    assert find_personal_data(docs, labelled_table(spark)).count() == 299
