"""Naive Bayes against plain Python, many labels, and what no language fits."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from glyphgrid.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cell(gram, dimensions):
    h = len(gram)
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
    return h >> (64 - dimensions.bit_length() + 1)


def grams(text, dimensions):
    padded = f" {text.lower()} "
    return [cell(padded[i : i + n], dimensions) for n in langid.ORDERS for i in range(len(padded) - n + 1)]


def table(n=120):
    rnd = random.Random(4)
    words = {"en": "the of and ing tion er".split(), "de": "der und sch ung ein zu".split(), "el": "και το της αυ ον ει".split()}
    rows = [(i, " ".join("".join(rnd.choices(words[k], k=2)) for _ in range(rnd.randint(1, 60))), k) for i, k in enumerate(rnd.choices(list(words), k=n))]
    return [*rows, (n, "Das \U0001f600 ist", "de"), (n + 1, None, "en"), (n + 2, "no label", None), (None, "no id", "en"), (n + 3, "12 !", "de"), (n + 4, "", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in table()], SCHEMA).repartition(3)


def test_plain_naive_bayes(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 500)
    held = {r.doc_id: r.held_out for r in docs.select("doc_id", langid.held_out().alias("held_out")).collect()}
    train = [(t, k) for i, t, k in table() if held[i] is False and t is not None and k]
    d, languages = 1024, sorted({k for _, k in train})
    counts = {k: Counter(g for t, own in train if own == k for g in grams(t, d)) for k in languages}
    total = {k: sum(counts[k].values()) + langid.SMOOTHING * d for k in languages}
    out = {r.doc_id: r for r in langid.predict(docs, langid.train(docs, dimensions=d)).collect()}
    for i, t, _ in table():
        if not t or not any(c.isalpha() for c in t):
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
            continue
        p = np.array([math.log(sum(k == own for _, own in train) / len(train)) + sum(math.log((counts[k][g] + langid.SMOOTHING) / total[k]) for g in grams(t, d)) for k in languages])
        p = np.exp(p - p.max())
        assert out[i].lang_pred == languages[int(p.argmax())] and abs(out[i].score - p.max() / p.sum()) < 1e-3


def test_what_fits_no_language_goes(spark, docs):
    more = spark.createDataFrame([(1000, "\u0434\u043e\u0431\u0440\u044b\u0439 \u0432\u0435\u0447\u0435\u0440 \u0432\u0441\u0435\u043c", None, None, 7), (1001, "x9Qz7Kw2 0pL8vB3m ZtR5 qY1c", "xx", "s", 7), (1002, "der schein und ungein", None, "s", None)], SCHEMA)
    out = {r.doc_id: r for r in langid.accepted_rows(docs.unionByName(more)).collect()}
    assert set(out) == {i for i, t, _ in table() if t and any(c.isalpha() for c in t)} | {1002}
    assert out[1002].lang == "de" and out[1002].n_chars is None and out[122].lang is not None and out[None].text == "no id"


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "MATRIX_CELLS", 1 << 19)
    rows = [(7 * i + j, f"{'abcdefghijklmnopqrstuvwxyz'[k % 26] * 3}{'abcdefghijklmnopqrstuvwxyz'[k // 26] * 4} word", f"l{k:03}") for i, k in enumerate(range(500)) for j in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.weights.shape == (1024, len(model.languages)) and len(model.languages) > 490
    found, _ = model.judged([t for _, t, _ in rows[::7]])
    assert np.mean([a == k for a, (_, _, k) in zip(found, rows[::7], strict=True)]) > 0.9


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 3), (2, "12", None, "s", 2), (3, None, None, None, None)], SCHEMA)
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}
    assert [r.doc_id for r in langid.accepted_rows(docs).collect()] == [1]
    assert langid.accepted_rows(docs.limit(0)).count() == 0
